"""textmend.sources"""
