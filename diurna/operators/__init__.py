"""diurna.operators"""
