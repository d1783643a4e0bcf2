"""Operators on flow tables; every one is a lazy DataFrame job unless its text names an action."""
