"""The training-data queries, by name."""

from __future__ import annotations

from textrill.llm import language, mixing, neardup, packing, pii, reading, repair


def queries() -> dict:
    return {
        "p1_found": language.p1_found,
        "p1_rows": language.p1_rows,
        "p1_segments": language.p1_segments,
        "p2_found": pii.p2_found,
        "p2_sanitised": pii.p2_sanitised,
        "p2_terms": pii.p2_terms,
        "p2_disclosures": pii.p2_disclosures,
        "p3_found": repair.p3_found,
        "p3_repaired": repair.p3_repaired,
        "p4_found": repair.p4_found,
        "p4_canonical": repair.p4_canonical,
        "p5_found": neardup.p5_found,
        "p5_groups": neardup.p5_groups,
        "p6_packed": packing.p6_packed,
        "p6_report": packing.p6_report,
        "p7_mixture": mixing.p7_mixture,
        "p7_report": mixing.p7_report,
        "p8_found": reading.p8_found,
        "p8_levels": reading.p8_levels,
        "p8_profile": reading.p8_profile,
    }


P5_FOUND = r"""
WITH w AS (SELECT id, regexp_extract_all(strip_accents(lower(content_norm)), '[\p{L}\p{N}]+') AS w FROM index_documents WHERE content_norm <> ''),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
b AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
SELECT id_a, id_b FROM b JOIN n p ON p.id = id_a JOIN n q ON q.id = id_b WHERE c >= 0.6 * (p.n + q.n - c)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the others are tested against brute force, round trips or held-out rows."""
    return {"p5_found": P5_FOUND}
