"""The registered queries of the folder, on the smallest tables."""

import os

import pytest

from tests.oracle_check import compare, connect
from tidemark.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

#: What the contracts ask for.
COLUMNS = {
    "op1": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op3": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5": {"pair_id": "bigint", "prompt": "string", "chosen": "string", "rejected": "string"},
    "op6": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint",
            "base_labels": "string", "labels": "string", "score": "double"},
    "op7": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint",
            "sequence_id": "bigint", "offset": "bigint"},
    "op8": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint",
            "base_sha256": "string", "spans": "string"},
    "op9": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string",
            "spans": "string"},
    "op10": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
             "explained": "double", "identity_error": "double"},
    "op12": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op13": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint",
             "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
}


@needs_tables
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, SF_DIR)
    kinds = dict(frame.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name.split("_")[0]]} == COLUMNS[name.split("_")[0]]
    good, note = compare(spark, connect(SF_DIR), SF_DIR, name)
    assert good, note


def test_one_query_per_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)
