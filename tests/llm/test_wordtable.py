import hashlib
import json
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismara.llm import wordtable

PATH = P.path("byte_bpe_50k.json")
ODD = ("a  <|endoftext|>  b<|endoftext|>", "<|endoftext|>", "don't they'll 'S '", "x   \x85\x1c\x1dy  \n\n z ", "क़́‍\U0001f469‍\U0001f680!!", "\U00031350\U00016100Ᲊ\U0001ccf3 1\U00010d40", "!<|endoftext|!", "�\x00 \x7f", " 　 tail  ")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_round_trip_is_the_librarys(spark, docs, rows):
    t, want = library(), []
    more = spark.createDataFrame([(1000 + i, x, *[None] * (len(docs.columns) - 2)) for i, x in enumerate(ODD)], docs.schema)
    for doc_id, text in [*((r[0], r[1]) for r in rows), *((1000 + i, x) for i, x in enumerate(ODD))]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want.append((repr(doc_id), len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = wordtable.round_trip(docs.union(more), PATH).collect()
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)


def test_every_assigned_character_beside_others(spark):
    """A letter, a number, a space or neither, as the library has it."""
    rng, texts = random.Random(3), []
    known = [c for c in range(0x32400) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(known), 97):
        texts.append("".join(rng.choice(("a", "1", "!", " ", "")) + chr(c) for c in known[i : i + 97]))
    t = library()
    df = wordtable.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH)
    assert all(r["ids"] == t.encode(r["text"], add_special_tokens=False).ids for r in df.collect())


def test_columns_and_decoding(docs, rows):
    df = wordtable.decode(wordtable.encode(docs, PATH), PATH)
    assert df.columns == [*docs.columns, "ids", "decoded"]
    found = df.collect()
    assert len(found) == len(rows) and all(r["decoded"] == (r["text"] or "") for r in found)
    assert sorted(wordtable.encode(df, PATH).columns) == sorted(df.columns)


def test_small_runs_and_merges_give_the_same(docs, rows, monkeypatch):
    """Many runs, texts that are longer than a run, and several merges for a bucket."""
    t = library()
    for name, value in (("RUN_WORDS", 50), ("MERGE_BYTES", 64)):
        monkeypatch.setattr(wordtable, name, value)
    batch = wordtable.pa.RecordBatch.from_pydict({"c": [r[0] for r in rows], "words": [[w for w, _ in t.pre_tokenizer.pre_tokenize_str(r[1] or "")] for r in rows]})
    runs = list(wordtable._runs(iter([batch])))
    assert sum(len(x) for _, r, _, _ in runs for x in r) == len(rows) and all(len(run.codes) <= 50 or sum(map(len, r)) == 1 for _, r, _, run in runs)
    dealt = [(nr, run.digest, *b) for nr, _, _, run in runs for b in run.buckets(3)]
    dealt.sort(key=lambda x: x[2])
    names = ("run", "digest", "bucket", "words", "numbers")
    fed = wordtable.pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*dealt, strict=True)), strict=True)))
    assert len({w for x in dealt for w in wordtable._listed(x[3])}) > 100
    assert sum(b.num_rows for b in wordtable._table_rows(PATH, iter([fed]))) == len(dealt)


def test_other_vocabularies(spark, tmp_path):
    """Merges out of the order of ids, two added tokens, and ids without a token."""
    order = [*wordtable.alphabet(), "ab", "abc", "bc", "Ġa"]
    random.Random(8).shuffle(order)
    vocab = {c: i for i, c in enumerate(order)}
    model = {"type": "BPE", "vocab": vocab, "merges": [["b", "c"], ["a", "b"], ["Ġ", "a"], ["a", "bc"]]}
    added = [{"id": 260 + i, "content": x, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": i == 0} for i, x in enumerate(("<a>", "[x]"))]
    path = str(tmp_path / "own.json")
    told = {"version": "1.0", "added_tokens": added, "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "model": model}
    open(path, "w").write(json.dumps(told))
    t = Tokenizer.from_file(path)
    texts = ["abc ab<a>abc [x]a", "bcbcabab", "<a><a>", "[x", " a ab abcabc"]
    df = wordtable.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    for r in df.collect():
        assert r["ids"] == t.encode(r["text"], add_special_tokens=False).ids
    assert wordtable.load(path).decode([vocab["ab"], 10_000, vocab["Ġa"], -1, 260]).decode() == t.decode([vocab["ab"], vocab["Ġa"], 260], skip_special_tokens=False)
    told["pre_tokenizer"]["add_prefix_space"] = True
    open(path + "2", "w").write(json.dumps(told))
    with pytest.raises(ValueError):
        wordtable.load(path + "2")


def test_nulls_and_empty_tables(spark, empty):
    assert wordtable.round_trip(empty, PATH).collect() == [] and wordtable.encode(empty, PATH).collect() == []
    none = spark.createDataFrame([(None, None, None)], "doc_id long, text string, ids array<int>")
    assert wordtable.decode(none, PATH).first()["decoded"] == ""
    r = wordtable.round_trip(none, PATH, keep=("doc_id", "ids")).first()
    assert r["n_tokens"] == 0 and r["ids"] is None and r["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    twice = wordtable.round_trip(none.union(none).select("doc_id", F.lit("same").alias("text")), PATH).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
