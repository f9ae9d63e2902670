"""voidloom.plans"""
