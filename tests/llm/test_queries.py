"""The registered queries over the smallest tables: against their SQL, or a plain version."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from lectern.llm import decontamination, registry

from .cases import words
from .test_pairs import align, fold
from .test_rows import plain_spans
from .test_web import expected


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, sf_dir, tables, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), tables.execute(registry.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    # a whole number is one, whether a null beside it made its column one of doubles or not
    whole = lambda x: None if x is None or x != x else int(x) if isinstance(x, float) and x.is_integer() else x
    key = lambda d: sorted(str(tuple(map(whole, r))) for r in d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_contracts(spark, sf_dir, tables):
    docs = tables.execute("SELECT doc_id, text FROM documents").fetchall()
    text = dict(docs)
    run = lambda name: registry.QUERIES[name](spark, sf_dir).collect()

    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in run("op4_warc")]
    assert sorted(got, key=str) == expected(tables.execute("SELECT page_id, url, html FROM pages").fetchall())

    for r in run("op5_secret_scan"):
        base = plain_spans(text[r.doc_id])
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in base) for k in range(3)]

    slots, where = defaultdict(list), {}
    for r in run("op8_sharding"):
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data)) and 0 <= r.shard < 16
        slots[r.shard].append((r.slot, r.size))
        assert where.setdefault(text[r.doc_id], r.shard) == r.shard
    assert all(sorted(x for x, _ in s) == list(range(len(s))) for s in slots.values())

    from tokenizers import Tokenizer

    from lectern.llm.token_counts import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    for r in run("op9_token_counts"):
        n = len(tok.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 2048)


def test_decontamination_over_the_table(spark, sf_dir, tables):
    """Brute force: every document that shares a trigram with an item, aligned as a whole with it."""
    items = [(i, words(fold(t))) for i, t in tables.execute("SELECT item_id, text FROM benchmark").fetchall()]
    want = set()
    for d, t in tables.execute("SELECT doc_id, text FROM documents").fetchall():
        w = words(fold(t))
        own = set(zip(w, w[1:], w[2:], strict=False))
        for i, item in items:
            if own & set(zip(item, item[1:], item[2:], strict=False)) and align(item, w) >= decontamination.needed(len(item), decontamination.LEAST):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in registry.QUERIES["op10_decontamination"](spark, sf_dir).collect()}
    assert got == want
