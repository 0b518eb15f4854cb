"""textmend.operators"""
