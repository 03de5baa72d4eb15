"""SQL that several queries share, from the definitions and not from the plans."""

from __future__ import annotations


def words_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '[^a-z0-9]+'), lambda x: x <> '')"


def candidates_sql(fields: list[str], k: int, all_words: bool) -> str:
    """c (id, match): the k rows of e (id, type and the fields) that BM25 ranks first for each row's name, among others of its type."""
    each = " UNION ALL ".join(f"SELECT id, type, '{f}' AS field, {words_sql(f)} AS w FROM e" for f in fields)
    return f"""tokens AS ({each}), st AS (SELECT field, count(*) AS n, avg(len(w)) AS al FROM tokens GROUP BY 1),
  tf AS (SELECT id, type, field, len, term, count(*) AS tf FROM (SELECT id, type, field, len(w) AS len, unnest(w) AS term FROM tokens) GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY 1, 2),
  weights AS (SELECT id, type, term, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS weight FROM tf JOIN df USING (field, term) JOIN st USING (field) GROUP BY 1, 2, 3),
  asked AS (SELECT id, type, unnest(list_distinct(w)) AS term, len(list_distinct(w)) AS wanted FROM tokens WHERE field = 'name'),
  scored AS (SELECT q.id, w.id AS match, wanted, count(*) AS hit, round(sum(weight), 9) AS score FROM asked q JOIN weights w ON w.type = q.type AND w.term = q.term AND w.id <> q.id GROUP BY 1, 2, 3),
  c AS (SELECT id, match FROM scored {"WHERE hit = wanted" if all_words else ""} QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, match) <= {k})"""
