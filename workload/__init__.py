"""The given test tables seen as call logs, and one query per operator over them."""
