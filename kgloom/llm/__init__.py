"""Operations of a large training-data pipeline, on DataFrames.

Nothing outside this subpackage imports it. ``kgloom.llm.entries`` lists the
registered queries, one for each operator.
"""
