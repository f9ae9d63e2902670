"""voidloom.functions"""
