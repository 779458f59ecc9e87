"""Operations of a training-data pipeline over document and page tables.

Nothing outside this subpackage imports it.
"""
