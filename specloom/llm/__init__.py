"""Operators for preparing training corpora.

Nothing else in the package imports this subpackage. Every operator is a plain
function from DataFrames to a DataFrame with its own general interface; the
thin ``opN_*`` queries that derive digest columns are in :mod:`.queries`.

Conventions shared by the operators: a null text counts as empty, extra columns
are left alone (or dropped where a narrow result is documented), an empty table
gives an empty result, and rows are never dropped, sampled or capped.
"""
