"""Meetings of blocks grow with the square of a family; the tasks that they are dealt over don't."""

import random

from geostrain.llm import common, ngram_join


def test_tasks_do_not_follow_the_meetings(spark, monkeypatch):
    """Every four meetings were a Python task, each of which left memory in its executor."""
    monkeypatch.setattr(common, "MOST_TASKS", 20)
    monkeypatch.setattr(ngram_join, "BLOCK", 1)
    kind = type(spark.range(1))
    asked, plain = [], kind.repartition

    def repartition(self, n, *columns):
        asked.append(n)
        return plain(self, n, *columns)

    monkeypatch.setattr(kind, "repartition", repartition)
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join([*words[: 4 * i], f"own{i}", *words[4 * i + 1 :]])) for i in range(40)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.component_id, r.n_links) for r in got} == {(0, 39)} and len(got) == 40
    numbers = [n for n in asked if isinstance(n, int)]
    assert len(numbers) >= 3 and max(numbers) <= 20
    assert common.meeting_tasks(spark, 10**7) == common.meeting_tasks(spark, 10**9) == 20
