"""voidloom.streaming"""
