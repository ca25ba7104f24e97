"""Operations a training-data pipeline needs: counting, matching, scoring, mixing and sharding documents.

Nothing else in the library imports this subpackage.
"""
