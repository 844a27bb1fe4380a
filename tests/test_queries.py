"""Registered queries against their SQL on the smallest tables.

By default a sample that touches every module; FULL_QUERIES=1 runs all of them.
"""

import os

import duckdb
import pytest

from structscreen.bindings import load

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = (
    "all_policies_report", "final_rerank", "merge_screening", "balanced_sample", "balanced_pick", "hit_summary", "combine_caches",
    "radius_pairs_per_supplier", "scaled_radius_join", "tiered_neighbors", "clash_score", "lddt_with_binding_site", "complex_statistics",
    "backbone_dihedrals", "side_chain_dihedrals", "rotatable_bonds", "token_ids", "alignment_columns", "trusted_window", "batches_padded",
    "structure_sequences", "residue_index", "validation_metrics", "classifier_metrics", "variant_scores", "contact_precision", "mean_embeddings",
    "robust_map", "pdb_round_trip", "mmcif_round_trip", "multi_model_text", "score_report", "stream_meter",
)
REGISTRY = load()
NAMES = [n for n, q in REGISTRY.items() if q.sql and (os.environ.get("FULL_QUERIES") or n in SAMPLE)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if v is None or v != v:
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = REGISTRY[name].run(spark, SF)
    cur = con.execute(REGISTRY[name].sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(map(tuple, df.collect()), df.columns) == canonical(cur.fetchall(), columns)
