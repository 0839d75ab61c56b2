"""The other dealt operators against plain versions on small tables."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as tok
import pytest
from pantrygrid.llm import exact_dedup, html_text, mixing, quality, tokens, top_inner, toxicity

SCHEMA = "doc_id long, text string, source string, id string"


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeABé'1") for _ in range(rng.randint(1, 9)))
    rows = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "Same text"), (53, "same TEXT"), (53, "same text"), (None, "SAME text"), (60, " \n" * 400 + "x" + " " * 900), (61, "word " * 30000), (62, "it's <|endoftext|> here")]
    return [(k, t, None, "x") for k, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is None, x) for x in row)


def test_exact_dedup(docs, none):
    norm = [(k, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for k, t, *_ in texts()]
    want = []
    for k, t in norm:
        ids = [i for i, x in norm if x == t]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((k, keep, len(ids), keep == k, hashlib.sha256(t.encode()).hexdigest()))
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert exact_dedup.exact_dedup(none).collect() == []


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    path = tok.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = [(k, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 1024) for k, t, *_ in texts()]
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(docs, path).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert tokens.token_counts(none, path).collect() == []


def test_byte_bpe_round_trip(docs, none):
    import tiktoken

    path = tok.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for k, t, *_ in texts():
        ids = enc.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in tokens.bpe_round_trip(docs, path, tok.PATTERN).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert tokens.bpe_round_trip(none, path, tok.PATTERN).collect() == []


def test_top_inner(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).round(2).tolist() if k % 9 else [0.25] * 8) for k in range(90)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (203, [float("inf")] * 8)]
    df = spark.createDataFrame([(k, v, k) for k, v in rows], "vec_id long, embedding array<double>, rank int")
    whole = {k: np.floor(64 * np.array(v)).astype(int) for k, v in rows if k < 200}
    want = []
    for q in (k for k in whole if k % 20 == 0):
        best = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q)[:20]
        want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(best)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_inner.top_k(df.where("vec_id % 20 = 0"), df).collect())
    assert got == sorted(want)
    assert top_inner.top_k(df.limit(0), df.limit(0)).collect() == []


def test_html_text(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First   part\nof the text, which is long enough to be one.</p><script>no()</script><p>Second caf&eacute;.</p></article><section class=comments><p>I think so too, and said it before.</p></section><footer>Legal words</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<article><p>open"), (None, "x", "<<<>&&")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "A & B\nFirst part of the text, which is long enough to be one.\nSecond café."
    assert got[1] == (text, len(text)) and got[2] == ("", 0) and got[3] == ("", 0) and len(got) == 5


def held_out(k):
    return zlib.crc32(str(k).encode()) % 3 == 1


def test_toxicity_on_held_out_rows(spark, none):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("rain fell on the quiet harbour while boats came home and people talked about bread".split()) for _ in range(n))
    rows = [(k, f"{say(30)} vile grumblefoot skunkbrain {say(10)}" if k % 3 == 0 else say(40), int(k % 3 == 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    assert all(got[k]["held_out"] == held_out(k) and 0 <= got[k]["score"] <= 1 for k, *_ in rows)
    test = [(got[k]["predicted"], y) for k, _, y in rows if held_out(k)]
    assert sum(p == y for p, y in test) / len(test) > 0.95
    assert toxicity.toxicity(none, df).collect() == []


def test_quality_rejects_junk_and_keeps_prose(spark, none):
    rng = random.Random(6)
    prose = lambda: " ".join(" ".join(rng.choice(["stone", "river", "walked", "slowly", "green", "window", "letter", "morning"]) + rng.choice("abcdefgh") for _ in range(9)).capitalize() + "." for _ in range(6))
    junk = lambda: " ".join(rng.choice(["CLICK!!!", "$$$", "BUY", "###", "%%%", "NOW!!!"]) for _ in range(50))
    rows = [(k, junk() if k % 4 == 0 else prose()) for k in range(200)] + [(900, None), (None, "")]
    got = {r["doc_id"]: r["accepted"] for r in quality.quality_classifier(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == (k % 4 != 0) for k in range(200)) and got[900] and got[None]
    assert quality.quality_classifier(none).collect() == []


def test_mixing_meets_targets(spark, none):
    say = {"en": "the house and the river were there", "fr": "la maison est dans le jardin avec elle"}
    rows = [(k, say["en" if k % 4 else "fr"] + f" {k}", "en" if k % 4 else "fr") for k in range(400)] + [(900, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    got = mixing.mix(df, df.where("doc_id % 2 = 0"), {"en": 0.5, "fr": 0.5}).collect()
    total = np.sum([r["rate"] * r["n_tokens"] * np.array(r["posteriors"]) for r in got], axis=0)
    assert len(got) == 401 and min(r["rate"] for r in got) >= 0 and abs(total[0] / total.sum() - 0.5) < 0.01
    assert mixing.mix(none, none.selectExpr("doc_id", "source as domain"), {"en": 1.0}).collect() == []
    more = mixing.mixed_documents(df, df, {"en": 0.5, "fr": 0.5}, never_less=True)
    assert more.columns == df.columns and {r["doc_id"] for r in more.collect()} == {k for k, *_ in rows}


def test_mixing_meets_targets_of_a_domain_of_a_thousandth(spark):
    say = ["the house and the river were there", "der Hund und die Katze sind nicht", "el perro y los gatos que viven", "la maison est dans le jardin avec elle"]
    kind = lambda k: 3 if k % 1000 == 0 else 2 if k % 1000 < 10 else 1 if k % 1000 < 30 else 0
    df = spark.createDataFrame([(k, f"{say[kind(k)]} {k}", "abcd"[kind(k)]) for k in range(2000)], "doc_id long, text string, domain string").repartition(3)
    share = np.array([0.4, 0.2, 0.2, 0.2])
    targets = dict(zip("abcd", share))
    got = mixing.mix(df, df, targets).collect()
    total = np.sum([r["rate"] * r["n_tokens"] * np.array(r["posteriors"]) for r in got], axis=0)
    assert np.abs(total / sum(r["n_tokens"] for r in got) - share).max() < 1e-5
    mixer, narrow = mixing.fit(df, df, targets, never_less=True)
    p, n = (np.array(x) for x in zip(*((r["p"], r["tokens"]) for r in narrow.collect())))
    total = (mixer.rates(p) * n) @ p
    assert mixer.rates(p).min() >= 1 and np.abs(total / total.sum() - share).max() < 1e-5


def test_mixing_says_when_no_rates_meet_the_targets(spark):
    df = spark.createDataFrame([(k, "the same words") for k in range(20)], "doc_id long, text string")
    with pytest.warns(UserWarning, match="no rates meet"):
        got = mixing.mix(df, df.limit(0).selectExpr("doc_id", "text as domain"), {"a": 0.75, "b": 0.25}).collect()
    assert all(abs(r["rate"] - 1) < 1e-6 for r in got)  # half the tokens to each domain is the nearest
