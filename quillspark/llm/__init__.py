"""Training-data operators: ten document-level steps and the queries over them.

Nothing outside this folder imports it; removing it leaves the rest of the
library intact.
"""
