"""Source text to facts.

`extract(content, lang)` gives rows in the columns of the fact tables, with positions; their `finished` adds ids, lines
and enclosing definitions.
"""
