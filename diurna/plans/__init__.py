"""diurna.plans"""
