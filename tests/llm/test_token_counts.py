import json
import random

import pytest

from sparkloom.llm.token_counts import count_tokens, default_path, special_strings


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def expected(library, rows, limit=1024):
    out = []
    for doc_id, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        out.append((doc_id, len((text or "").encode()), n, n > limit))
    return sorted(map(repr, out))


def test_numbers_are_those_of_the_library(spark, library):
    rnd = random.Random(2)
    parts = ["word", "Word's", "don't", "'s", "12", "4096", "...", "é", "ß", "日本語", "🙂", "=", "_", "a_b", "<|endoftext|>", "<|endoftext", "<|", "\x00", "ǅ", "①", "̈", "٣"]
    gaps = [" ", " ", " ", " ", "", "  ", "\n", " \n", "\n ", "\t", "\r\n", "\xa0", " ", "　 ", " \x1c", "\x1f ", "\x85", " ", "   \n\n  "]
    rows = [(None, "no id"), (1, None), (2, ""), (3, " "), (4, "   "), (5, "\n"), (6, "a  b"), (6, "a  b"), (7, " lead and trail "), (8, "<|endoftext|>"), (9, "a\n <|endoftext|> b<|endoftext|>\n c"), (10, "x" * 30000), (11, "same words " * 4000)]
    rows += [(100 + i, "".join(rnd.choice(parts) + rnd.choice(gaps) for _ in range(rnd.randrange(1, 40)))) for i in range(1500)]
    rows += [(5000 + i, "".join(chr(rnd.choice([rnd.randrange(32, 0x3000), rnd.randrange(32, 127), 32, 32, rnd.randrange(0x1F000, 0x1FB00)])) for _ in range(60))) for i in range(500)]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, token string, n_tokens int").repartition(5)
    assert sorted(map(repr, map(tuple, count_tokens(docs, 30).collect()))) == expected(library, rows, 30)


def test_whole_table_equals_the_library(spark, library):
    from sparkloom.llm.queries import queries

    got = queries()["op11_token_counts"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, got.collect()))) == expected(library, rows)


def test_numbers_do_not_depend_on_what_workers_remember(spark, library, monkeypatch):
    from sparkloom.llm import token_counts

    monkeypatch.setattr(token_counts, "KNOWN", 3)
    monkeypatch.setattr(token_counts, "ROWS", 2)
    rows = [(i, f"one two{i} three-{i % 3} four " * (1 + i % 4)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(repr, map(tuple, count_tokens(docs).collect()))) == expected(library, rows)


def test_empty_table_and_other_vocabularies(spark, tmp_path):
    assert count_tokens(spark.createDataFrame([], "doc_id string, text string")).collect() == []
    spec = json.loads(open(default_path()).read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        special_strings(str(tmp_path / "t.json"))
