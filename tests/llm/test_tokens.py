import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(text, rule):
    """Each token is given to its line by its own characters, one by one."""
    t = Tokenizer.from_file(PATH)
    _, ends = tokens.line_sections(text)
    out = [0.0] * len(ends)
    of = lambda c: next(i for i, e in enumerate(ends) if c < e)
    for a, b in t.encode(text, add_special_tokens=False).offsets:
        own = [of(c) for c in range(a, b)]
        if rule == "first":
            out[own[0]] += 1
        elif rule == "last":
            out[own[-1]] += 1
        elif rule == "most":
            out[max(sorted(set(own)), key=own.count)] += 1
        else:
            for s in own:
                out[s] += 1 / len(own)
    return out


TEXTS = ["one line", "a\nb", "\n\n\n  x\n \n", "é😀\n日本\n", "word\n\n\n\nword <|endoftext|>\n", "tail\n"]


@pytest.mark.parametrize("rule", tokens.RULES)
def test_equals_brute_force(spark, rule):
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, section int")
    got: dict = {}
    for r in tokens.section_tokens(d, PATH, rule).orderBy("id", "section").collect():
        got.setdefault(r["id"], []).append(r["n_tokens"])
    for i, t in enumerate(TEXTS):
        assert np.allclose(got[i], brute(t, rule))


def test_cases(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "w " * 100_000), (3, "w " * 100_000), (None, "a\nb")], "doc_id long, text string")
    got = tokens.section_tokens(d, PATH).collect()
    assert sorted((r["id"] or 0, r["n_tokens"] > 0) for r in got) == [(0, True), (0, True), (1, False), (2, False), (3, True), (3, True)]
    assert tokens.section_tokens(d.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        tokens.section_tokens(d, PATH, "random")


def test_counts_add_up(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    from barloom.llm.bpe import encode

    rows = d.select("doc_id", "text").collect()
    e = encode([r["text"] for r in rows], PATH)
    want = {r["doc_id"]: n for r, n in zip(rows, np.diff(e.bounds).tolist())}
    got = {r["id"]: r["n"] for r in tokens.section_tokens(d, PATH).groupBy("id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert got == want
