"""textmend.plans"""
