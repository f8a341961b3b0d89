"""diurna.functions"""
