"""textmend.streaming"""
