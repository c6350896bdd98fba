"""From text to plans: the dialect's own syntax, functions and procedures."""
