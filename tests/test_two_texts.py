"""Two extractions side by side: what both have in common is made once."""

from __spark_entry__ import queries


def test_words_are_cut_and_summed_up_once(spark, data):
    """Before, each side was read for its figures and for its print, and its words were cut for the figure and for the verdict."""
    found = queries()["j19_two_texts"](spark, data)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1
    assert plan.count("md5(") == 1
    assert found.where("print_a <> print_b or diversity_a <> diversity_b or chars_a <> chars_b").count() == 0
