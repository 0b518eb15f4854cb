"""textmend.functions"""
