"""voidloom.operators"""
