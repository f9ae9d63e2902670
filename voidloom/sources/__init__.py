"""voidloom.sources"""
