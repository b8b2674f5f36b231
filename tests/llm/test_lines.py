from __future__ import annotations

import hashlib

import cases
import numpy as np

from gevel.llm import lines as n


def plain(rows):
    """Texts without chunks of several lines that stand at an earlier place, by a dict of bytes."""
    known = sorted({(d is None, d or 0, d, t) for d, t in rows}, key=lambda r: (r[0], r[1], str(r[3])))
    known.sort(key=lambda r: (r[0], r[1], HASHES[r[3]]))
    seen, out = set(), {}
    for _, _, d, t in known:
        left = b""
        for a, b, lines in n.chunks((t or "").encode()):
            data = (t or "").encode()[a:b].removesuffix(b"\n")
            if lines < n.FEWEST or data not in seen:
                left += (t or "").encode()[a:b]
            if lines >= n.FEWEST:
                seen.add(data)
        out[d, t] = hashlib.sha256(left).hexdigest()
    return sorted(((d, out[d, t]) for d, t in rows), key=str)


HASHES: dict = {}


def check(df):
    from gevel.llm.common import text_hash

    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    HASHES.clear()
    HASHES.update({r[0]: r[1] for r in df.select("text", text_hash()).collect()})
    got = n.digest(n.cut_lines(df))
    assert cases.rows_of(got, "doc_id", "kept_sha256") == sorted(plain(rows), key=lambda r: tuple((x is None, str(x)) for x in r))
    return got


def test_awkward_rows(spark):
    df = cases.docs(spark)
    assert n.drop_repeated(df).schema.names == df.schema.names
    got = {r["doc_id"]: r for r in check(df).collect()}
    assert got[10]["n_removed"] > 0 and got[1]["n_chunks"] == 0


def test_given_documents(spark):
    check(cases.mixed(spark))


def test_empty(spark):
    assert n.drop_repeated(cases.empty(spark)).count() == 0


def test_same_hash_for_different_bytes(spark, monkeypatch):
    """Strings that share a hash are told apart by their bytes."""
    import pyarrow as pa

    real = n._hashes

    def weak(batches):
        for b in real(batches):
            one = pa.array([1] * b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], one, one], b.schema.names)

    monkeypatch.setattr(n, "_hashes", weak)
    check(cases.docs(spark))


def test_boundaries_fall_in_step_again():
    rng = np.random.default_rng(1)
    lines = [f"line {x}" for x in rng.integers(0, 10**6, 300)]
    text = "\n".join(lines).encode()
    moved = ("new first line\n" + "\n".join(lines[:100] + ["another"] + lines[100:])).encode()
    pieces = {text[a:b] for a, b, _ in n.chunks(text)}
    again = {moved[a:b] for a, b, _ in n.chunks(moved)}
    assert len(pieces & again) > 0.8 * len(pieces)


def test_chunks_cover_the_text():
    for text in (b"", b"\n", b"a", b"a\n", b"a\nb", b"\n\n\n", b"x\n" * 100):
        parts = n.chunks(text)
        assert b"".join(text[a:b] for a, b, _ in parts) == text
        assert all(1 <= k <= n.MOST for _, _, k in parts)
