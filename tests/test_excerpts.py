"""Compact sources against a plain version of the rule."""

import random

import pytest

from citewright.operators import excerpts, prompts


def plain(text, question, room):
    text = (text or "").strip(" ")
    if len(text) <= room:
        return text, False
    blocks = excerpts.blocks_of(text)
    words = {w for w in "".join(c if c.isalnum() else " " for c in (question or "").lower()).split() if len(w) >= 3 and w not in excerpts.ASK_NOTHING}
    score = [10 * sum(min(3, b.lower().count(w)) for w in words) + 3 * any(s in "".join(c if c.isalnum() else " " for c in b[:140].lower()).split() for s in excerpts.SECTIONS) for b in blocks]
    best = sorted(range(len(blocks)), key=lambda i: (-score[i], -i))
    order = [k for i in best if score[i] >= 10 for k in (i, max(0, i - 1), min(len(blocks) - 1, i + 1))] + [0, len(blocks) - 1, min(1, len(blocks) - 1), *best]
    used, kept = len(excerpts.OMITTED), set()
    for i in dict.fromkeys(order):
        cost = len(blocks[i]) + len(excerpts.OMITTED) + 1
        if used + cost <= room:
            used, kept = used + cost, kept | {i}
    out, before = "", -2
    for i in sorted(kept):
        out, before = out + (excerpts.OMITTED if i != before + 1 else "") + blocks[i] + "\n", i
    return out + excerpts.OMITTED, True


@pytest.fixture(scope="module")
def sources():
    rng = random.Random(8)
    words = ["cell", "Cells", "river", "results", "Method", "of", "the", "discussion", "decay", "excellent", "x" * 30, "étude"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    texts = ["\n\n".join(say(rng.choice([2, 8, 30, 300])) for _ in range(rng.randrange(1, 40))) for _ in range(40)] + [None, "", "short", "z" * 5000, "a\n\nb", "\n \n".join("q" * 90 for _ in range(60))]
    return [(i, t, rng.choice([None, "", "What does the cell decay show?", "the paper of this?", "Étude? river!"]), rng.choice([200, 1500, 6000])) for i, t in enumerate(texts)]


def test_compact_sources(spark, sources):
    df = spark.createDataFrame(sources, "source_id int, text string, question string, room int").repartition(3)
    got = {r.source_id: (r.text, r.cut) for r in excerpts.compact_sources(df).collect()}
    assert sorted(got) == [s[0] for s in sources]
    for i, text, question, room in sources:
        assert got[i] == plain(text, question, room), i
        assert len(got[i][0]) <= room
    assert sum(cut for _, cut in got.values()) > 20


def test_comparison_takes_blocks(spark):
    text = "\n\n".join(["First part of it.", "y" * 1900, "Results were found here.", "Last part."])
    papers = spark.createDataFrame([("a", k, None, f"Paper {k}", text, None) for k in (1, 2)], "request_id string, paper_id int, doi string, title string, abstract string, summary string")
    prompt = prompts.comparison_prompts(papers, room=400).first().prompt
    assert "Results were found" in prompt and "Last part." in prompt and "yyy" not in prompt and "Paper 2" in prompt
