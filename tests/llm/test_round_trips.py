"""Chat formatting, alignment of tokenizers and fill-in-the-middle: exact round trips and brute force, with odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from logtrail.llm import chat_format, fill_middle, token_align
from logtrail.llm.packing import tokenizer_file

TURNS = "conv_id long, turn long, role string, text string, turns string, formatted string, loss string"


def conversations():
    marks = "".join(chat_format.DEFAULT.controls)
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("system", "be brief"), ("user", "a"), ("user", "b\\"), ("assistant", marks), ("assistant", "\\<s>"), ("user", "x")])]
    rows += [(2, 3, "assistant", "last"), (2, None, "user", None), (2, 1, None, "no role"), (2, 1, "", "empty role"), (2, 2, "tool <|end|>", "<<<<s>s>|\\\\<\\s>")]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same"), (None, 1, "assistant", "ok"), (None, 0, "user", ""), (4, 0, "assistant", "é" * 50_000), (5, 0, "user", None)]
    rows += [(6, i, ("user", "assistant")[i // 3 % 2], f"turn {i} [INST]") for i in range(2000)]
    return rows


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
        out[conv] = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
    return out


def test_chat_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "other", "columns", "clash") for r in rows], TURNS).repartition(3)
    formatted = chat_format.formatted(df)
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert [(t.role, t.text) for t in got[conv].turns] == turns, conv
        assert got[conv].loss_text == "".join(t for r, t in turns if r == "assistant"), conv
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:], strict=False))
        assert got[conv].formatted.count("<|turn|>") == got[conv].formatted.count("<|text|>") == got[conv].formatted.count("<|end|>") == blocks
        assert got[conv].formatted.count("<|also|>") == len(turns) - blocks
        assert not any(c in got[conv].formatted for c in chat_format.FOREIGN)
    assert chat_format.read_back(chat_format.formatted(df.filter("conv_id > 99"))).count() == 0


def test_chat_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat_format.read_back(chat_format.formatted(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_chat_templates(spark):
    with pytest.raises(ValueError):
        chat_format.Template(open="\\x")
    own = chat_format.Template("[A]", "[B]", "[C]", "[D]", learned="user", foreign=("<x>",))
    df = spark.createDataFrame([(1, 0, "user", "[A] [D]<x>"), (1, 1, "user", "[[B]"), (1, 2, "bot", "z")], "conv_id long, turn long, role string, text string")
    row = chat_format.read_back(chat_format.formatted(df, own), own).first()
    assert row.formatted == "[A]user[B][\\A] [\\D]<\\x>[C][[\\B][D][A]bot[B]z[D]" and row.loss_text == "[A] [D]<x>[[B]"


def units(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)


def fill_brute(doc_id, text):
    text = text or ""
    w, h = units(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(w), "plain", None, None, text
    lo, hi = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = ("".join(x) for x in (w[:lo], w[lo:hi], w[hi:]))
    spm = h4 % 100 < 80
    return len(w), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def odd_texts(seed=5, n=300):
    rng = random.Random(seed)
    chars = " \n\t\x0b\xa0ab'sÉ1.,-漢\U0001f600<P>S"
    some = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [None, "", " ", "\n\n", "a", " a", "a ", "<P>", "x <S> y", "<M", "<", "é " * 30_000, "w" * 100_000, *some, *some[:3]]


def test_fill_middle(spark):
    texts = odd_texts()
    rows = [(None if i % 50 == 7 else i // 2, t, "clash", "x") for i, t in enumerate(texts)]  # ids repeat and are null
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, output string").repartition(3)
    found = fill_middle.restore(fill_middle.transform(df)).collect()
    got = collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in found)
    assert got == collections.Counter((i, *fill_brute(i, t), t or "") for i, t, *_ in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.transform(df.filter("doc_id < 0"))).count() == 0


@pytest.mark.parametrize("unit", ["word", "char"])
def test_runs(unit):
    for text in [t or "" for t in odd_texts(6, 100)]:
        runs = fill_middle.encode_runs(text, unit)
        w = units(text) if unit == "word" else list(text)
        places = [0, *np.cumsum([len(x) for x in w]).tolist()]
        some = range(len(w) + 1) if len(w) < 100 else [0, 1, len(w) // 2, len(w)]
        assert runs.total == len(w) and [runs.place(k) for k in some] == [places[k] for k in some]


def align_brute(both, text):
    """Whole texts by the libraries themselves, ends merged token by token."""
    if not text:
        return (0, 0, 0, 0, ""), collections.Counter()
    a, b = both.a.encode.__self__.own.encode(" " + text, add_special_tokens=False).ids, both.b.encode.__self__.own.encode(text)
    of_a, of_b = [both.a.bytes[i] for i in a], [both.b.bytes[i] for i in b]
    if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
        return (0, 0, 0, 0, ""), collections.Counter()
    told, links, i, j, x, y, at_a, at_b = [], collections.Counter(), 0, 0, 0, 0, len(of_a[0]), len(of_b[0])
    while i < len(a) and j < len(b):
        if at_a == at_b:
            told.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
            links[a[i], b[j]] += 1
            x, y = i + 1, j + 1
        step_a, step_b = at_a <= at_b, at_b <= at_a
        if step_a:
            i += 1
            at_a += len(of_a[i]) if i < len(a) else 0
        if step_b:
            j += 1
            at_b += len(of_b[j]) if j < len(b) else 0
    return (len(a), len(b), len(told), sum(links.values()), hashlib.sha256(";".join(told).encode()).hexdigest()), links


@pytest.fixture(scope="module")
def files():
    return tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def align_texts():
    return [*odd_texts(7, 200), "don't we'll  stop ", "abc ", "<|endoftext|><s></s><unk>", "a ▁b", "▁", "\x00 \x1c \x85 x", "the cat sat on the mat " * 200, "the cat", "the cat", "日本" * 3000]


def test_token_align(spark, files):
    texts, both = align_texts(), token_align.Aligner(*files)
    want = [align_brute(both, t) for t in texts]
    assert sum(w[0][0] > 0 for w in want) > 150 and sum(w[0][0] == 0 for w in want) > 3
    count = sum((links for _, links in want), collections.Counter())
    best = [collections.Counter(), collections.Counter()]
    for pair, n in count.items():
        for side in (0, 1):
            best[side][pair[side]] = max(best[side][pair[side]], n)
    rows = [(None if i % 40 == 3 else i // 2, t, 1, "x") for i, t in enumerate(texts)]  # ids repeat and are null
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pairs string").repartition(3)
    found, pairs = token_align.align(spark, df, *files)
    full = []
    for (i, *_), (sizes, links) in zip(rows, want, strict=True):
        of = lambda side, links=links: sum(n for p, n in links.items() if count[p] == best[side][p[side]])
        full.append((i, *sizes[:4], of(1), sum(n * count[p] for p, n in links.items()), sizes[4], of(0)))
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(full)
    assert {(r.pair >> token_align.B_BITS, r.pair & ((1 << token_align.B_BITS) - 1)): r["count"] for r in pairs.collect()} == dict(count)
    nothing, none = token_align.align(spark, df.filter("doc_id < 0"), *files)
    assert nothing.count() == 0 and none.count() == 0


def test_pairs_beyond_the_broadcast(spark, files, monkeypatch):
    df = spark.createDataFrame(list(enumerate(align_texts()[13:60])), "doc_id long, text string")
    once = sorted(map(tuple, token_align.align(spark, df, *files)[0].collect()))
    monkeypatch.setattr(token_align, "PAIRS_BROADCAST", 0)
    assert sorted(map(tuple, token_align.align(spark, df, *files)[0].collect())) == once


def test_store_starts_anew(files, monkeypatch):
    both, texts = token_align.Aligner(*files), [t for t in align_texts() if t]
    monkeypatch.setattr(token_align, "STRETCHES_KEPT", 20)
    monkeypatch.setattr(token_align, "AT_ONCE", 15)
    got = [x for i in range(0, len(texts), 3) for x in both.align(texts[i : i + 3])]
    want = [align_brute(both, t)[0] for t in texts]
    assert [tuple(g[:5]) for g in got] == want


def test_merge_ends():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 20)))) for _ in "ab")
        at_a, at_b = token_align.merge_ends(a, b)
        assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
