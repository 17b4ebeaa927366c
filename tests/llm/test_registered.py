"""Every registered corpus query over the driver's smallest tables, against plain Python or a library."""

import collections
import hashlib
import os
import re
import shutil
import zlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.samples import no_documents, odd_documents
from tests.llm.test_scans import base_spans
from wayfare.llm import packing, queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def by_id(df):
    rows = df.collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_secrets(spark, texts):
    found = by_id(queries.op1_secret_scan(spark, FOLDER))
    assert set(found) == set(texts)
    for doc_id, text in texts.items():
        spans = base_spans(text)
        assert found[doc_id]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) <= set(found[doc_id]["spans"].split(",")) | {""}


def test_quality_rules(spark, texts):
    found = by_id(queries.op2_quality_rules(spark, FOLDER))
    assert set(found) == set(texts)
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        row = found[doc_id]
        assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words))
        assert row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert row["n_dup_lines"] == len(lines) - len(set(lines)) and row["n_repeat_words"] == len(again)
        assert row["base_failed"] == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert not (row["base_failed"] and row["kept"])


def test_bpe(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    found = by_id(queries.op3_bpe(spark, FOLDER))
    assert set(found) == set(texts)
    for doc_id, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        shown = library.decode(ids, skip_special_tokens=False)
        assert found[doc_id]["n_tokens"] == len(ids)
        assert found[doc_id]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert found[doc_id]["decoded_sha256"] == hashlib.sha256(shown.encode()).hexdigest()


def test_shards(spark, texts):
    found = by_id(queries.op5_sharding(spark, FOLDER))
    assert set(found) == set(texts)
    for doc_id, text in texts.items():
        assert found[doc_id]["size"] == len(text.encode()) + 8
        assert found[doc_id]["text_crc32"] == zlib.crc32(text.encode())
    slots = collections.defaultdict(list)
    for row in found.values():
        assert row["law"] == "rows" and row["grown_shard"] is None
        slots[row["shard"]].append(row["slot"])
    assert set(slots) == set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_packing(spark, texts):
    rows = queries.op6_best_fit_packing(spark, FOLDER).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {doc_id: len(text.encode()) + 1 for doc_id, text in texts.items()}
    assert {r["capacity"] for r in rows} <= set(packing.LENGTHS)


def test_quality_model(spark, texts):
    found = by_id(queries.op7_quality_model(spark, FOLDER))
    assert set(found) == set(texts)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    right = []
    for doc_id, row in found.items():
        assert row["held_out"] == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.5)
        if doc_id in labels:
            right.append(row["predicted"] == labels[doc_id])
    assert sum(right) >= 0.85 * len(right)  # trained on some fifty texts


def test_token_counts(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = by_id(queries.op10_token_counts(spark, FOLDER))
    assert set(found) == set(texts)
    for doc_id, text in texts.items():
        n = len(library.encode(text))
        row = found[doc_id]
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 4096)


@pytest.mark.parametrize("rows", [odd_documents, no_documents])
def test_the_pipeline_takes_odd_and_empty_tables(spark, tmp_path, rows):
    docs = rows(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copytree(f"{FOLDER}/labels.parquet", f"{tmp_path}/labels.parquet") if os.path.isdir(
        f"{FOLDER}/labels.parquet"
    ) else shutil.copy(f"{FOLDER}/labels.parquet", f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = collections.Counter()
    for r in packed:
        sizes[r["doc_id"]] += r["length"]
    if rows is no_documents:
        assert not packed
    else:
        assert packed and set(sizes) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert max(r["capacity"] for r in packed) <= max(packing.LENGTHS)
