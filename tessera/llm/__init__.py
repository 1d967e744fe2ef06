"""Training-data operators: each module is one operator; nothing outside this subpackage imports it."""
