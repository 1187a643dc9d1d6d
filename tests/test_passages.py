"""Passages in one pass against a plain loop, long documents, and documents read from files."""

import random
import re
import time

import pytest

from logtrail.operators import passages
from logtrail.schema import Config
from logtrail.sources.logs import markdown_documents, write_markdown


def looped(text, most, overlap):
    """Paragraph by paragraph: the passages that the rule defines."""
    out, title, held, above = [], "", [], ""
    for block in re.split(r"\n\s*\n", text or ""):
        block = block.strip()
        if block.startswith("#"):
            title = block.lstrip("#").strip()
        elif block:
            new = bool(held) and title != above
            if held and (new or sum(map(len, held)) + len(block) > most):
                out.append((above, "\n\n".join(held)))
                held = [] if new or not overlap else held[-overlap:]
            held.append(block)
            above = title
    return [*out, (above, "\n\n".join(held))] if held else out


def texts():
    rng = random.Random(8)
    block = lambda: rng.choice(["# A", "## B b ", "#", "# A\nmore", "x" * rng.randint(1, 30), "é" * rng.randint(1, 30), "word " * rng.randint(1, 9), " ", ""])
    return [None, "", "\n\n", "# only", "one", *["\n\n".join(block() for _ in range(rng.randint(1, 30))) for _ in range(120)], "a\n \t\nb", "x" * 5000]


@pytest.mark.parametrize(("most", "overlap"), [(40, 1), (40, 0), (25, 3), (900, 1)])
def test_chunks_against_a_loop(spark, most, overlap):
    some = texts()
    df = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(some)], "source string, text string, heading int").repartition(3)
    got = {}
    for r in passages.chunks(df, Config(chunk_chars=most, chunk_overlap=overlap)).collect():
        got.setdefault(r.source, {})[r.at] = (r.heading, r.content)
    for i, t in enumerate(some):
        found = got.get(str(i), {})
        assert [found[k] for k in range(len(found))] == looped(t, most, overlap), i


def test_long_documents_take_linear_time(spark):
    def seconds(n):
        text = "\n\n".join(f"# h{i}" if i % 50 == 0 else f"paragraph {i} with words" for i in range(n))
        df = spark.createDataFrame([("a", text)], "source string, text string")
        began = time.time()
        assert passages.chunks(df).count() > n / 50
        return time.time() - began

    seconds(100)
    assert seconds(100_000) < 15  # was 37 s for 20,000


def test_documents_of_files(spark, tmp_path):
    folder = f"file://{tmp_path}/docs"
    docs = [("b.md", "# T\n\ntext é"), ("a.md", ""), ("c d.md", None), ("e.txt", "no")]
    write_markdown(spark.createDataFrame(docs, "source string, text string"), folder)
    (tmp_path / "docs" / "w.md").write_bytes(b"one\r\ntwo\rthree\n")
    got = [(r.source, r.text) for r in markdown_documents(spark, folder).collect()]
    assert got == [("a.md", ""), ("b.md", "# T\n\ntext é"), ("c d.md", ""), ("w.md", "one\ntwo\nthree\n")]
    with pytest.raises(FileNotFoundError):
        write_markdown(spark.createDataFrame([("x.txt", "")], "source string, text string"), f"file://{tmp_path}/none")
        markdown_documents(spark, f"file://{tmp_path}/none")
