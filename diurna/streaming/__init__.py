"""diurna.streaming"""
