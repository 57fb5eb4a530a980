"""Numbers of tokens of whole texts under a byte-level BPE vocabulary, without the tokens.

A pre-token here is a stretch of text that no token crosses: the vocabulary's own rule starts a new one at
every space that something other than white space follows, so texts are cut there, and around special
strings. The rule goes on to cut within such a stretch; the library does that when it counts.

    texts --cut--> blocks of texts: distinct pre-tokens with the block's texts that hold them and how often,
                   dealt by the pre-tokens' hash into buckets; one row for each block and bucket
    bucket         each pre-token is counted by the library once in the whole corpus (all blocks' shares of
                   it lie in one bucket); numbers join to the frequencies and give sums by text
    sums           added up by block: one array of numbers for each bucket, a number for each text

What is shuffled are distinct pre-tokens of blocks, compressed, and sums. A frequent pre-token is one entry a
block, which lists a text once, so no bucket is larger than others by it. Workers remember at most KNOWN
pre-tokens and then begin anew, so memory has a bound; a bucket of more counts some again, with equal results.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import vec
from sparkloom.llm.store import arrow_map

#: A space before something that is no white space to anyone (Python counts more as such than the vocabulary does).
_CUT = re.compile(r" (?=\S)")
#: A space at which a text must not be cut, in RE2's words.
_KEEP = r" (?:$|[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])"
#: Rows of a block of texts, and bytes; pre-tokens that a worker remembers: fixed numbers, so that memory has a bound.
ROWS, BYTES, KNOWN = 1 << 14, 24 << 20, 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def special_strings(path: str) -> list[str]:
    """Strings that the library takes as one token wherever they stand. Raises ValueError for a
    vocabulary whose texts can't be cut at spaces."""
    spec = json.loads(Path(path).read_text())
    rule = spec.get("pre_tokenizer") or {}
    plain = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
    added = spec.get("added_tokens") or []
    loose = [t for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["content"].strip() or " " in t["content"]]
    if not plain or spec.get("normalizer") or spec["model"]["type"] != "BPE" or loose:
        raise ValueError(f"{path}: only byte-level BPE whose texts are independent at spaces")
    return [t["content"] for t in added]


def _pre_tokens(column: pa.Array, special: re.Pattern | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of a string column, and for each occurrence its pre-token and its row."""
    odd = pc.match_substring_regex(column, _KEEP)
    if special:
        odd = pc.or_(odd, pc.match_substring_regex(column, special.pattern))
    odd = odd.to_numpy(zero_copy_only=False)
    simple = np.flatnonzero(~odd)
    split = pc.split_pattern(column.take(pa.array(simple)), " ")
    parts, ends = split.flatten(), split.offsets.to_numpy()
    names = parts.dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + 1  # odd: a space before it
    code[ends[:-1][ends[:-1] < ends[1:]]] -= 1
    row = np.repeat(simple, np.diff(ends))
    words = names.dictionary.cast(pa.string())
    used, place = np.unique(code, return_inverse=True)
    text = words.take(pa.array(used >> 1))
    text = pc.if_else(pa.array((used & 1).astype(bool)), pc.binary_join_element_wise("", text, " "), text)
    loose, loose_row = [], []
    for i in np.flatnonzero(odd).tolist():
        whole = column[i].as_py()
        for j, part in enumerate(special.split(whole) if special else [whole]):
            if special and j % 2:
                new = [part]
            else:
                first, *rest = _CUT.split(part)
                new = [first, *(f" {x}" for x in rest)]
            loose += new
            loose_row += [i] * len(new)
    more = pa.array(loose, pa.string()).dictionary_encode()
    table = pa.concat_arrays([text, more.dictionary])
    where = np.concatenate([place, len(text) + more.indices.to_numpy(zero_copy_only=False).astype(np.int64)])
    at = np.concatenate([row, np.array(loose_row, dtype=np.int64)])
    both = table.dictionary_encode()  # the two ways may name the same pre-token
    return both.dictionary, both.indices.to_numpy(zero_copy_only=False).astype(np.int64)[where], at


def _packed(columns: dict) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def _blocks(special: re.Pattern | None, buckets: int):
    def rows(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi in _slices(batch.column("text")):
                column, n = pc.fill_null(batch.column("text").slice(lo, hi - lo), ""), hi - lo
                words, code, row = _pre_tokens(column, special)
                pair, times = np.unique(code * n + row, return_counts=True)
                used, first = np.unique(pair // n, return_index=True)
                token = words.take(pa.array(used))
                data, offsets = vec.text_bytes(token)
                bucket = (vec.word_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)
                ends = np.append(first, len(pair)).astype(np.int32)
                doc, count = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((pair % n).astype(np.uint16), times.astype(np.int32)))
                order = np.argsort(bucket, kind="stable")
                at, begin = np.unique(bucket[order], return_index=True)
                keys, payloads = [number % buckets], [_packed({"doc_id": batch.column("doc_id").slice(lo, n), "n_bytes": pc.binary_length(column).cast(pa.int64())})]
                for key, where in zip(at.tolist(), np.split(order, begin[1:]), strict=True):
                    keys.append(key)
                    payloads.append(_packed({"token": token.take(pa.array(where)), "docs": doc.take(pa.array(where)), "counts": count.take(pa.array(where))}))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(keys, pa.int64()), "block": pa.repeat(pa.scalar(number, pa.int64()), len(keys)), "size": pa.repeat(pa.scalar(n, pa.int32()), len(keys)), "payload": pa.array(payloads, pa.binary())})
                number += 1

    return rows


def _slices(column: pa.Array):
    """Row ranges of a batch of at most ROWS rows and BYTES bytes, or of one row."""
    total = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    at = 0
    while at < len(column):
        end = min(at + ROWS, max(at + 1, int(np.searchsorted(total, total[at] + BYTES, side="right")) - 1), len(column))
        yield at, end
        at = end


def _sums(path: str, most: int):
    def rows(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        known: dict[str, int] = {"": 0}

        for batch in batches:
            for block, n, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "size", "payload")), strict=True):
                part = _unpacked(payload)
                if "doc_id" not in part.schema.names:
                    tokens = part.column("token").to_pylist()
                    if len(known) > most:
                        known = {"": 0}
                    new = [t for t in tokens if t not in known]
                    for at in range(0, len(new), 4096):
                        some = new[at : at + 4096]
                        known.update(zip(some, map(len, tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
                    pieces = np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
                    docs, counts = part.column("docs"), part.column("counts")
                    weight = np.repeat(pieces, pc.list_value_length(docs).to_numpy()) * docs_values(counts)
                    payload = _packed({"n": pa.array(np.bincount(docs_values(docs), weights=weight, minlength=n).astype(np.int64))})
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "payload": pa.array([payload], pa.binary())})

    def docs_values(lists: pa.ListArray) -> np.ndarray:
        return lists.flatten().to_numpy().astype(np.int64)

    return rows


def _totals(key, rows):
    """Rows of a block's texts, from its heads and its buckets' sums."""
    total, heads = 0, None
    for payload in rows.column("payload").to_pylist():
        part = _unpacked(payload)
        if "doc_id" in part.schema.names:
            heads = part
        else:
            total = total + part.column("n").to_numpy()
    n = pa.array(np.broadcast_to(total, len(heads)).astype(np.int64))
    return pa.Table.from_arrays([heads.column("doc_id"), heads.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, limit: int = 1024, path: str | None = None) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_bytes (of UTF-8), n_tokens, over_limit (n_tokens > limit).

    `path` is a tokenizers file of byte-level BPE, the same on every executor; numbers are those of the
    library's encode without added begin or end, special strings counting as one token each.

    Null and empty texts have none; null and repeated ids and repeated rows are rows like others; other
    columns make no difference; texts are taken whole; an empty table gives an empty one."""
    path = path or default_path()
    strings = special_strings(path)
    special = re.compile("(" + "|".join(map(re.escape, sorted(strings, key=len, reverse=True))) + ")") if strings else None
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = text.transform(arrow_map, _blocks(special, 2 * partitions), "bucket long, block long, size int, payload binary")
    dealt = blocks.repartition(partitions, "bucket").sortWithinPartitions("bucket").select("block", "size", "payload")
    sums = dealt.transform(arrow_map, _sums(path, KNOWN), "block long, payload binary")
    schema = T.StructType().add("doc_id", text.schema["doc_id"].dataType).add("n_bytes", "long").add("n_tokens", "long")
    out = sums.groupBy("block").applyInArrow(_totals, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
