"""Byte-level BPE by recursive DuckDB queries, in each partition, over the partition's distinct words.

A text is split into the pattern's matches; only words that a worker has not met go to DuckDB. There they are token-position
rows. A recursive query joins each pair of neighbours to the merge table, contracts each word's leftmost pair of least rank, and
stops at the fixpoint; an ordered aggregation over the vocabulary's bytes decodes the ids again. Texts are then put together from
their words' ids and bytes. For words of over LONG bytes, a contraction a step would be quadratic: a second recursive query contracts, in each step, all pairs of
the word's least rank that don't overlap, from the left. That is the same, as no new pair can have a lower rank than the one it contains.

Null text is empty text: 0 tokens and the digests of nothing. Null ids and repeated rows are kept. An empty table gives no rows.
Other columns are not read. Memory: a slice of about SLICE bytes of text, the worker's cache, and DuckDB's own limit.
"""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import byte_slices

SLICE, LONG, CACHED, MEMORY = 8 << 20, 200, 700_000, "300MB"
#: White space as the pattern's \s has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Where the pattern's matches can be cut without a look at letters: before a word with at most one space, and around other white space.
PIECE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

ENCODE = """
with recursive tokens(step, word, pos, id, size) as (
  select 0, word, pos, id, 1 from units
  union all
  (
    with pairs as materialized (
      select l.step, l.word, l.pos, l.id, l.size, r.pos as next, r.size as next_size, made
      from tokens l left join tokens r on r.word = l.word and r.pos = l.pos + l.size left join merges on left_id = l.id and right_id = r.id
    )
    select step + 1, word, pos,
           case when pos = best % 4294967296 then best // 4294967296 else id end,
           case when pos = best % 4294967296 then size + next_size else size end
    from pairs
    join (
      select word, min(made::bigint * 4294967296 + pos) as best, arg_min(next, made::bigint * 4294967296 + pos) as gone
      from pairs where made is not null group by word
    ) using (word)
    where pos <> gone
  )
)
select word, pos, id from tokens join (select word, max(step) as step from tokens group by word) using (word, step)
"""
#: For long words: pairs of the least rank that follow each other without a gap overlap, and every other one of such a run is contracted.
ENCODE_LONG = """
with recursive tokens(word, step, pos, id) using key (word) as (
  select word, 0, list(pos order by pos), list(id order by pos) from units group by word
  union
  select word, step + 1, list(pos order by n), list(case when taken then made else id end order by n)
  from (
    select *, coalesce(lag(taken) over (partition by word order by n), false) as gone
    from (
      select *, least and row_number() over (partition by word, least, n - in_kind order by n) % 2 = 1 as taken
      from (
        select *, row_number() over (partition by word, least order by n) as in_kind
        from (
          select word, step, n, pos, id, made, coalesce(made = min(made) over (partition by word), false) as least
          from (
            select word, step, n, pos, id, lead(id) over (partition by word order by n) as next_id
            from (select word, step, unnest(range(1, len(pos) + 1)) as n, unnest(pos) as pos, unnest(id) as id from tokens)
          ) left join merges on left_id = id and right_id = next_id
        )
      )
    )
  )
  where not gone
  group by word, step
  having bool_or(taken)
)
select word, unnest(pos)::int as pos, unnest(id)::int as id from tokens
"""
#: Rows come sorted, which spares a sort for each word; sound tells whether the aggregation took a word's rows in that order.
DECODE = """
select word, n, ids, hex, places = list_sort(places) as sound
from (
  select word, count(*) as n, string_agg(' ' || id, '') as ids, string_agg(hex, '') as hex, list(pos) as places
  from (select word, pos, id, hex from coded join vocabulary using (id) order by word, pos) group by word
)
"""
#: Where it did not.
DECODE_ORDERED = """
select word, count(*) as n, string_agg(' ' || id, '' order by pos) as ids, string_agg(hex, '' order by pos) as hex
from coded join vocabulary using (id) group by word
"""
_made: dict[tuple[str, str], Bpe] = {}


class Bpe:
    """From a word to (ids, each after a space; number of ids; decoded bytes); one per worker, file and pattern: of(path, pattern)."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.seen: dict[str, tuple[bytes, int, bytes]] = {}
        self.older: dict[str, tuple[bytes, int, bytes]] = {}
        self.units = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.spill = tempfile.TemporaryDirectory(prefix="bpe-")  # goes with the worker
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.spill.name})
        made = [(self.ranks[t[:k]], self.ranks[t[k:]], c) for t, c in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        merges = pa.table(dict(zip(("left_id", "right_id", "made"), (pa.array(x, pa.int32()) for x in zip(*made, strict=True)), strict=True)))
        names = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        self.db.register("merges_in", merges)
        self.db.register("names_in", names)
        self.db.execute("create table merges as select * from merges_in; create table vocabulary as select * from names_in")

    @staticmethod
    def of(path: str, pattern: str) -> Bpe:
        if (path, pattern) not in _made:
            _made[path, pattern] = Bpe(path, pattern)
        return _made[path, pattern]

    def encode(self, words: list[str]) -> None:
        """Adds words to seen."""
        raws = [w.encode() for w in words]
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        inner: tuple[list[int], list[int]] = ([], [])
        for k, raw in enumerate(raws):
            whole = self.ranks.get(raw)
            if whole is not None:
                rows.append((np.array([k]), np.array([0]), np.array([whole])))
            else:
                inner[len(raw) > LONG].append(k)
        for query, own in zip((ENCODE, ENCODE_LONG), inner, strict=True):
            if own:
                sizes = np.array([len(raws[k]) for k in own])
                starts = np.cumsum(sizes) - sizes
                units = pa.table({"word": pa.array(np.repeat(own, sizes), pa.int32()), "pos": pa.array(np.arange(sizes.sum()) - np.repeat(starts, sizes), pa.int32()), "id": self.units[np.frombuffer(b"".join(raws[k] for k in own), np.uint8)]})
                self.db.register("units", units)
                got = self.db.execute(query).fetchnumpy()
                rows.append((got["word"], got["pos"], got["id"]))
        coded = pa.table({n: pa.array(np.concatenate(c), pa.int32()) for n, c in zip(("word", "pos", "id"), zip(*rows, strict=True), strict=True)})
        self.db.register("coded", coded)
        got = self.db.execute(DECODE).fetchnumpy()
        if not got["sound"].all():
            got = self.db.execute(DECODE_ORDERED).fetchnumpy()
        for k, n, ids, text in zip(got["word"].tolist(), got["n"].tolist(), got["ids"].tolist(), got["hex"].tolist(), strict=True):
            self.seen[words[k]] = (ids.encode(), n, bytes.fromhex(text))

    def unknown(self, words: set[str]) -> set[str]:
        """Those of words that are in neither half of the cache; the others are in seen then."""
        words = words.difference(self.seen)
        again = words.intersection(self.older)
        self.seen.update(zip(again, map(self.older.__getitem__, again), strict=True))
        return words - again

    def texts(self, raws: list[bytes]) -> list[list[tuple[bytes, int, bytes]]]:
        """The words of each text, encoded and decoded."""
        if len(self.seen) > CACHED // 2:  # words that come again are taken over from the older half, so that none of them is contracted anew
            self.older, self.seen = self.seen, {}
        pieces = [PIECE.findall(raw.decode()) for raw in raws]
        split = {p: self.pattern.findall(p) for p in self.unknown(set(chain.from_iterable(pieces)))}
        if new := list(self.unknown(set(chain.from_iterable(split.values())))):
            for i in range(0, len(new), 50_000):
                self.encode(new[i : i + 50_000])
        for p, words in split.items():
            if len(words) > 1:
                got = [self.seen[w] for w in words]
                self.seen[p] = (b"".join(g[0] for g in got), sum(g[1] for g in got), b"".join(g[2] for g in got))
        return [[self.seen[p] for p in some] for some in pieces]


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs(doc_id, text); ranks: a .tiktoken file at the same path on each machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(ranks, pattern)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            out = []
            for a, b in byte_slices(pc.binary_length(texts).to_numpy(), SLICE):
                for words in bpe.texts(texts.slice(a, b - a).to_pylist()):
                    ids = b"".join([w[0] for w in words])[1:]
                    out.append((sum([w[1] for w in words]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join([w[2] for w in words])).hexdigest()))
            n, ids, decoded = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
