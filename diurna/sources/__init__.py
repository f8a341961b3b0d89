"""diurna.sources"""
