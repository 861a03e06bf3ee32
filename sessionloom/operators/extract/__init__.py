"""Facts from session text (EXT): each rule set is a column expression over messages."""
