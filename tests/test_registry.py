"""Every inventory row has a registered query, and every query can be checked or says why not."""

from twinlens.plans.catalogue import QUERIES

ROWS = {"A": 16, "B": 24, "C": 34, "D": 16, "E": 12, "F": 9, "G": 17, "H": 9, "I": 8, "J": 12, "K": 18, "L": 7, "N": 1}


def test_every_inventory_row_is_covered():
    wanted = {f"{k}{i}" for k, n in ROWS.items() for i in range(1, n + 1)}
    covered = {row for q in QUERIES.values() for row in q.rows.split()}
    assert wanted - covered == set()
    assert covered - wanted == set()


# Queries that SQL cannot state: sequential pairing and what follows from it, and the HTML scanner's rows. Tests compare
# the pairing with a plain sequential one (test_align) and the scanner's rows with small pages (test_jobs, test_limits).
WITHOUT_SQL = {
    "content_align", "content_findings", "image_findings", "image_stats", "price_findings", "price_stats", "run_compare",
    "run_statistics", "store_sizes", "extract_images",
}
ROWS_WITHOUT_SQL = {"F1", "F4", "G1", "J3", "J4", "J10", "K18", "B23"}


def test_only_named_queries_are_without_second_engine_sql():
    assert {n for n, q in QUERIES.items() if not q.sql} == WITHOUT_SQL
    checked = {row for q in QUERIES.values() if q.sql for row in q.rows.split()}
    covered = {row for q in QUERIES.values() for row in q.rows.split()}
    assert covered - checked == ROWS_WITHOUT_SQL
