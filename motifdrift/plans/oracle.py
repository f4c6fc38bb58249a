"""SQL twins of the registered queries, for an engine that reads the same Parquet tables (DuckDB's dialect)."""

from __future__ import annotations

from motifdrift import settings
from motifdrift.plans.fixtures import BATCH, PIECE, PIECE_BITS, STEPS, WIDTH
from motifdrift.plans.queries import SEED

DIMS = [f"d{i}" for i in range(1, WIDTH + 1)]
LIMIT = int(len(settings.site_positions()) * settings.DIFFERENCE_SHARE)


def h(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def quarter_of(day: str) -> str:
    return f"year({day})::VARCHAR || '-q' || ((quarter({day}) - 1) * 3 + 1)::VARCHAR"


def month_of(day: str) -> str:
    return f"CASE WHEN NOT (month({day}) = 2 AND day({day}) = 29) THEN year({day})::VARCHAR || '-' || month({day})::VARCHAR END"


TRIGRAMS = "[substr(sequence, i, 3) FOR i IN range(1, length(sequence) - 1)]"
SITES = "(VALUES " + ", ".join(f"({i}, {p})" for i, p in enumerate(settings.site_positions())) + ") AS sites(ordinal, position)"

#: Named steps, in order; each may use those before it.
STEP: dict[str, str] = {
    "pieces": f"""
        SELECT doc_id * {1 << PIECE_BITS} + piece AS record_idx, source, substr(letters, piece * {PIECE} + 1, {PIECE}) AS s0
        FROM (SELECT *, unnest(range(0, greatest(1, (length(letters) + {PIECE - 1}) // {PIECE}))) AS piece
              FROM (SELECT doc_id, source, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM documents))""",
    "isolates": f"""
        SELECT record_idx,
               '>Spike|iso/' || source || '/' || (h % 400)::VARCHAR || '|' || (2020 + h % 2)::VARCHAR || '-' || lpad((1 + (h // 2) % 12)::VARCHAR, 2, '0')
                 || '-' || lpad(((h // 24) % 32)::VARCHAR, 2, '0') || '|EPI|x' AS description,
               (CASE WHEN (h // 768) % 10 = 0 THEN s0 ELSE translate(s0, 'BJZX', 'ALGS') END)
                 || (CASE WHEN (h // 7680) % 20 = 0 THEN '' ELSE '*' END) AS sequence
        FROM (SELECT *, {h('record_idx::VARCHAR')} AS h FROM pieces)""",
    "split": """
        SELECT record_idx, sequence, string_split(description, '|')[2] AS isolate_name, string_split(description, '|')[3] AS stamp FROM isolates""",
    "shifted": """
        SELECT *, substr(stamp, 1, length(stamp) - 2) || (right(stamp, 2)::INT + 1)::VARCHAR AS shifted FROM split""",
    "days": "SELECT *, try_strptime(shifted, '%Y-%m-%d')::DATE AS day FROM shifted",
    "valid": f"""
        SELECT *, (record_idx // {BATCH})::INT AS batch_no FROM days
        WHERE NOT regexp_matches(sequence, '[BJZX-]') AND sequence LIKE '%*' AND length(sequence) BETWEEN 1260 AND 1280""",
    "batched": "SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY batch_no, isolate_name ORDER BY record_idx) = 1",
    "cleaned": "SELECT * FROM batched WHERE day IS NOT NULL",
    "monthly": f"""
        SELECT * FROM (SELECT *, {month_of('day')} AS period FROM cleaned) WHERE period IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY period, isolate_name ORDER BY batch_no, day, record_idx) = 1""",
    "quarterly": f"""
        SELECT * FROM (SELECT *, {quarter_of('day')} AS period FROM cleaned)
        QUALIFY row_number() OVER (PARTITION BY period, isolate_name ORDER BY batch_no, day, record_idx) = 1""",
    "months": """
        SELECT period, (row_number() OVER (ORDER BY string_split(period, '-')[1]::INT, string_split(period, '-')[2]::INT) - 1)::INT AS period_idx
        FROM (SELECT DISTINCT period FROM monthly)""",
    "runs": f"""
        SELECT (row_number() OVER (ORDER BY period_idx) - 1)::INT AS window_id,
               list(period) OVER (ORDER BY period_idx ROWS BETWEEN CURRENT ROW AND {settings.WINDOW_SIZE} FOLLOWING) AS run FROM months""",
    "windows": f"SELECT window_id, run[1:{settings.WINDOW_SIZE}] AS x, run[{settings.WINDOW_SIZE + 1}] AS y FROM runs WHERE len(run) = {settings.WINDOW_SIZE + 1}",
    "dated": "SELECT * FROM valid WHERE day IS NOT NULL",
    "base": "SELECT sequence AS b FROM dated ORDER BY length(sequence) DESC, record_idx LIMIT 1",
    "cut": f"""
        SELECT record_idx, {quarter_of('day')} AS period, ((year(day) - 2020) * 4 + quarter(day))::INT AS period_idx,
               ({h("'cl|' || record_idx::VARCHAR")} % 3)::INT AS cluster, ({h("'cut|' || record_idx::VARCHAR")} % 1260)::INT AS cut, sequence FROM dated""",
    "members": """
        SELECT record_idx, period, period_idx, cluster,
               substr(b, 1, cut) || substr(CASE WHEN record_idx % 3 = 0 OR (period_idx = 3 AND cluster = 2)
                 THEN substr(sequence, 1, length(sequence) - 3) || '*' ELSE sequence END, cut + 1) AS sequence FROM cut, base""",
    "grams": f"SELECT record_idx, unnest({TRIGRAMS}) AS trigram FROM members",
    "vocab": f"""
        SELECT (row_number() OVER (ORDER BY words) - 1)::INT AS idx, words,
               {', '.join(f"(({h(f"words || '|{j}'")} % 2001 - 1000) / 1000.0)::DOUBLE AS d{j}" for j in range(1, WIDTH + 1))}
        FROM (SELECT DISTINCT trigram AS words FROM grams WHERE NOT contains(trigram, '*'))""",
    "vectors": f"""
        SELECT record_idx, {', '.join(f'round(coalesce(sum({d}), 0), 8) AS {d}' for d in DIMS)}
        FROM grams LEFT JOIN vocab ON trigram = words GROUP BY record_idx""",
    "numbered": """
        SELECT *, row_number() OVER (PARTITION BY period_idx, cluster ORDER BY record_idx) - 1 AS member_no,
               count(*) OVER (PARTITION BY period_idx, cluster) AS n_members FROM members""",
    "preferred": """
        SELECT * EXCLUDE (has_it) FROM (SELECT *, bool_or(length(sequence) = 1274) OVER (PARTITION BY period_idx, cluster) AS has_it FROM members)
        WHERE length(sequence) = 1274 OR NOT has_it""",
    "chosen": """
        SELECT *, row_number() OVER (PARTITION BY period_idx, cluster ORDER BY record_idx) - 1 AS member_no,
               count(*) OVER (PARTITION BY period_idx, cluster) AS n_members FROM preferred""",
    "sizes": "SELECT DISTINCT period_idx, cluster, n_members FROM chosen",
    "sites_of": f"""
        SELECT period_idx, cluster, member_no, sequence, list_aggregate([substr(sequence, p + 1, 1) FOR p IN {settings.site_positions()}], 'string_agg', '') AS letters FROM chosen""",
    "neighbours": """
        SELECT record_idx, sequence, lead(sequence) OVER (PARTITION BY period_idx, cluster ORDER BY record_idx) AS next FROM members""",
    "compared": f"""
        SELECT record_idx, count(*) FILTER (substr(sequence, position + 1, 1) <> substr(next, position + 1, 1)) AS differences
        FROM neighbours, {SITES} WHERE next IS NOT NULL GROUP BY record_idx""",
    "member_means": f"""
        SELECT period_idx, cluster, [{', '.join(f'round(avg({d}), 6)' for d in DIMS)}] AS f
        FROM vectors JOIN members USING (record_idx) GROUP BY period_idx, cluster""",
    "points": "SELECT vec_id, (vec_id % 6)::INT AS period_idx, label::INT AS cluster, embedding::DOUBLE[] AS f FROM embeddings",
    "point_values": "SELECT vec_id, period_idx, cluster, pos - 1 AS pos, f[pos] AS v FROM (SELECT *, unnest(range(1, len(f) + 1)) AS pos FROM points)",
    "centroid_values": "SELECT period_idx, cluster, pos, round(avg(v), 6) AS v FROM point_values GROUP BY ALL",
    "centroids": "SELECT period_idx, cluster, list(v ORDER BY pos) AS f FROM centroid_values GROUP BY ALL",
    "start": "SELECT period_idx, (vec_id // 6)::INT AS cluster, f FROM points WHERE vec_id < 24",
    "walk_steps": f"""
        SELECT s, t, sequence FROM (SELECT record_idx AS s, unnest(range(0, {STEPS + 1})) AS t FROM members) w
        JOIN numbered n ON n.period_idx = 1 + s % 5 + t AND n.cluster = s % 3 AND n.member_no = s % n.n_members""",
    "walks": f"SELECT s, t, sequence FROM walk_steps QUALIFY count(*) OVER (PARTITION BY s) = {STEPS + 1}",
    "cells": f"""
        SELECT s, t, ordinal, list(v.idx ORDER BY i) AS cell
        FROM (SELECT s, t, ordinal, i, substr(substr(sequence, position - 1, 5), i + 1, 3) AS g FROM walks, {SITES}, (VALUES (0), (1), (2)) AS three(i))
        JOIN vocab v ON g = words GROUP BY s, t, ordinal""",
    "rows_": f"""
        SELECT s * {len(settings.site_positions())} + ordinal AS row_id, list(cell ORDER BY t) AS cs FROM cells GROUP BY s, ordinal""",
    "walk_rows": f"""
        SELECT row_id, CASE WHEN len(list_intersect(cs[{STEPS}], cs[{STEPS + 1}])) = 3 THEN 0 ELSE 1 END AS y, cs[1:{STEPS}] AS x FROM rows_""",
    "features": f"""
        SELECT row_id, y, step, {', '.join(f'sum({d}) AS {d}' for d in DIMS)}
        FROM (SELECT row_id, y, step, unnest(cell) AS idx FROM (SELECT row_id, y, generate_subscripts(x, 1) - 1 AS step, unnest(x) AS cell FROM walk_rows))
        JOIN vocab USING (idx) GROUP BY row_id, y, step""",
    "scores": f"""
        SELECT event_id AS row_id, event_id // 1000 AS epoch, (event_id % 1000) // 64 AS batch, (({h("'s0|' || event_id::VARCHAR")} % 4001 - 2000) / 1000.0)::DOUBLE AS s0,
               (({h("'s1|' || event_id::VARCHAR")} % 4001 - 2000) / 1000.0)::DOUBLE AS s1, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events""",
    "predicted": """
        SELECT *, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS p, 1 / (1 + exp(-abs(s0 - s1))) AS probability, 1 / (1 + exp(s0 - s1)) AS p1,
               ln(1 + exp(CASE WHEN y = 1 THEN s0 - s1 ELSE s1 - s0 END)) AS loss FROM scores""",
    "judged": "SELECT doc_id, quality AS y, toxic AS p FROM labels",
    "confusion": """
        SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn,
               count(*) FILTER (y = 0 AND p = 0) AS tn FROM judged""",
    "rates": """
        SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
               coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc,
               (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM confusion""",
    "by_score": """
        SELECT n_chars::DOUBLE AS threshold, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM judged JOIN documents USING (doc_id) GROUP BY 1""",
    "curve": """
        SELECT NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL
        SELECT threshold, (sum(n) OVER w)::DOUBLE / sum(n) OVER (), (sum(p) OVER w)::DOUBLE / sum(p) OVER () FROM by_score WINDOW w AS (ORDER BY threshold DESC)""",
}


def need(name: str, seen: list[str]) -> list[str]:
    """The steps that a text needs, in order."""
    import re

    text = STEP.get(name, name)
    for other in STEP:
        if other != name and re.search(rf"\b{other}\b", text) and other not in seen:
            need(other, seen)
            if other not in seen:
                seen.append(other)
    return seen


def sql(body: str, more: dict[str, str] | None = None) -> str:
    """body after the steps that it, or the steps in more, need."""
    names = need(body + " ".join((more or {}).values()), [])
    own = {n.removeprefix("RECURSIVE "): s for n, s in (more or {}).items()}
    steps = [f"{n} AS MATERIALIZED ({STEP[n]})" for n in STEP if n in names] + [f"{n} AS {'' if f'RECURSIVE {n}' in (more or {}) else 'MATERIALIZED '}({s})" for n, s in own.items()]
    first = "WITH RECURSIVE " if len(own) and any(n.startswith("RECURSIVE ") for n in more) else "WITH "
    return first + ",\n".join(steps) + "\n" + body if steps else body


def distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def nearest(points: str, centers: str) -> str:
    return f"""SELECT p.vec_id, p.period_idx, p.f, c.cluster, {distance('p.f', 'c.f')} AS dist2 FROM {points} p JOIN {centers} c USING (period_idx)
               QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY dist2, c.cluster) = 1"""


def means(assigned: str, centers: str) -> str:
    return f"""SELECT c.period_idx, c.cluster, coalesce(m.f, c.f) AS f FROM {centers} c LEFT JOIN (
                 SELECT period_idx, cluster, list(v ORDER BY pos) AS f FROM (
                   SELECT period_idx, cluster, pos, avg(f[pos]) AS v FROM (SELECT *, unnest(range(1, len(f) + 1)) AS pos FROM {assigned}) GROUP BY ALL) GROUP BY ALL) m
               USING (period_idx, cluster)"""


def long(centers: str) -> str:
    return f"SELECT period_idx, cluster, pos - 1 AS pos, round(f[pos], 5) AS v FROM (SELECT *, unnest(range(1, len(f) + 1)) AS pos FROM {centers})"


def links(centers: str) -> dict[str, str]:
    return {
        "ranked": f"SELECT *, dense_rank() OVER (ORDER BY period_idx) AS rank FROM {centers}",
        "pairs": f"SELECT a.period_idx, a.cluster AS src, b.cluster AS dst, sqrt({distance('a.f', 'b.f')}) AS dist FROM ranked a JOIN ranked b ON b.rank = a.rank + 1",
        "fwd": "SELECT period_idx, src, dst FROM pairs QUALIFY row_number() OVER (PARTITION BY period_idx, src ORDER BY dist, dst) = 1",
        "bwd": "SELECT period_idx, src, dst FROM pairs QUALIFY row_number() OVER (PARTITION BY period_idx, dst ORDER BY dist, src) = 1",
        "linked": f"""SELECT c.period_idx, c.cluster, coalesce(n, []) AS next_cluster FROM {centers} c LEFT JOIN (
                        SELECT period_idx, src AS cluster, list_sort(list_distinct(list(dst))) AS n FROM (SELECT * FROM fwd UNION ALL SELECT * FROM bwd) GROUP BY ALL) USING (period_idx, cluster)""",
    }


def first_picks(samples: str, rounds: int, seed: str = str(SEED)) -> dict[str, str]:
    """starts: the first member of each walk of samples (sample_id, period_idx) in each round."""
    of = lambda what: h(f"'{seed}|' || sample_id::VARCHAR || '|' || turn::VARCHAR || '|0|0|{what}'")
    return {
        "listed": "SELECT period_idx, list_sort(list(DISTINCT cluster)) AS cs FROM chosen GROUP BY 1",
        "turns": f"SELECT sample_id, s.period_idx, turn, cs[({of('cluster')} % len(cs))::INT + 1] AS cluster FROM {samples} s JOIN listed USING (period_idx), range(0, {rounds}) AS r(turn)",
        "starts": f"SELECT t.*, {of('member')} % n_members AS member_no FROM turns t JOIN sizes USING (period_idx, cluster)",
    }


def all_walks(samples: str, size: str, seed: str = str(SEED)) -> dict[str, str]:
    """Steps of walks.sample_walks for samples; done: sample_id, turn, seqs. A walk that fails starts again in the next round."""
    of = lambda step, attempt, what: h(f"'{seed}|' || sample_id::VARCHAR || '|' || turn::VARCHAR || '|' || ({step})::VARCHAR || '|' || {attempt} || '|{what}'")
    return first_picks(samples, settings.MOST_ROUNDS, seed) | {
        "RECURSIVE walking": f"""
            SELECT sample_id, turn, 0 AS step, period_idx, cluster, letters, [sequence] AS seqs FROM starts JOIN sites_of USING (period_idx, cluster, member_no) WHERE turn = 0
            UNION ALL
            SELECT s.sample_id, n.turn + CASE WHEN n.c IS NULL THEN 1 ELSE 0 END, CASE WHEN n.c IS NULL THEN 0 ELSE n.step + 1 END,
                   CASE WHEN n.c IS NULL THEN s.period_idx ELSE n.period_idx + 1 END, CASE WHEN n.c IS NULL THEN s.cluster ELSE n.c.cluster END,
                   CASE WHEN n.c IS NULL THEN f.letters ELSE n.c.letters END, CASE WHEN n.c IS NULL THEN [f.sequence] ELSE list_append(n.seqs, n.c.sequence) END
            FROM (
              SELECT sample_id, turn, step, period_idx, first(seqs) AS seqs,
                     arg_min(good, attempt) FILTER (good IS NOT NULL) AS c
              FROM (
                SELECT w.*, CASE WHEN step + 1 = {size} OR len(list_filter(range(1, {len(settings.site_positions()) + 1}), lambda i: substr(w.letters, i, 1) <> substr(m.letters, i, 1))) <= {LIMIT}
                                 THEN struct_pack(cluster := m.cluster, letters := m.letters, sequence := m.sequence) END AS good
                FROM (
                  SELECT t.*, z.n_members, {of('step + 1', 'attempt::VARCHAR', 'member')} % z.n_members AS member_no
                  FROM (SELECT w.*, next_cluster[({of('step + 1', "'0'", 'link')} % greatest(len(next_cluster), 1))::INT + 1] AS target,
                               unnest(range(0, CASE WHEN step + 1 < {size} THEN {settings.ATTEMPTS} ELSE 1 END)) AS attempt
                        FROM walking w JOIN linked l USING (period_idx, cluster) WHERE step < {size}) t
                  LEFT JOIN sizes z ON z.period_idx = t.period_idx + 1 AND z.cluster = t.target) w
                LEFT JOIN sites_of m ON m.period_idx = w.period_idx + 1 AND m.cluster = w.target AND m.member_no = w.member_no)
              GROUP BY sample_id, turn, step, period_idx) n
            JOIN starts s ON s.sample_id = n.sample_id AND s.turn = n.turn + CASE WHEN n.c IS NULL THEN 1 ELSE 0 END
            JOIN sites_of f ON f.period_idx = s.period_idx AND f.cluster = s.cluster AND f.member_no = s.member_no""",
        "done": f"SELECT sample_id, turn, seqs FROM walking WHERE step = {size}",
    }


SAMPLES = "SELECT record_idx AS sample_id, (1 + record_idx % 5)::INT AS period_idx FROM members"
WINDOW = f"SELECT least({settings.WINDOW_SIZE}, count(*) - 1) AS size, min(period_idx) AS first FROM (SELECT DISTINCT period_idx FROM member_means)"
EVERYONE = "SELECT record_idx AS sample_id, first AS period_idx FROM members, spans"
HALF_OF_DOCUMENTS = f"SELECT unnest(range(0, (SELECT (count(*) * {len(settings.site_positions())} // 2) // {len(settings.site_positions())} FROM documents))) AS sample_id, (SELECT first FROM spans) AS period_idx"
EACH_DOCUMENT = "SELECT unnest(range(0, (SELECT count(*) FROM documents))) AS sample_id, (SELECT first FROM spans) AS period_idx"


def walked_rows(walks: str) -> dict[str, str]:
    """made: row_id, y, x of walks (sample_id, seqs)."""
    return {
        "taken": f"SELECT sample_id AS s, generate_subscripts(seqs, 1) - 1 AS t, unnest(seqs) AS sequence FROM {walks}",
        "met": f"""SELECT s, t, ordinal, list(v.idx ORDER BY i) AS cell
                   FROM (SELECT s, t, ordinal, i, substr(substr(sequence, position - 1, 5), i + 1, 3) AS g FROM taken, {SITES}, (VALUES (0), (1), (2)) AS three(i))
                   JOIN vocab v ON g = words GROUP BY s, t, ordinal""",
        "lined": f"SELECT s * {len(settings.site_positions())} + ordinal AS row_id, list(cell ORDER BY t) AS cs FROM met GROUP BY s, ordinal",
        "made": "SELECT row_id, CASE WHEN len(list_intersect(cs[-2], cs[-1])) = 3 THEN 0 ELSE 1 END AS y, cs[1:len(cs) - 1] AS x FROM lined",
    }


def rounded(columns: list[str], places: int) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


def epochs(source: str) -> str:
    """Epoch roll-up of batch counts in source."""
    return f"""
        SELECT epoch, n_rows, loss, (tp + tn) / n_rows AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, coalesce(num / nullif(den, 0), 0) AS mcc
        FROM (SELECT epoch, max(n_rows) AS n_rows, avg(loss) AS loss, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, sum(tp::DOUBLE * tn - fp::DOUBLE * fn) AS num,
                     sum(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))) AS den
              FROM (SELECT epoch, batch, max(n_rows) AS n_rows, avg(loss) AS loss, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp,
                           count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM {source} GROUP BY epoch, batch)
              GROUP BY epoch)"""


F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END"


def order_periods(expression: str) -> str:
    return f"SELECT period, count(*) AS n FROM (SELECT {expression} AS period FROM (SELECT o_orderdate::DATE AS d FROM orders)) WHERE period IS NOT NULL GROUP BY period"


def oracle_sql() -> dict[str, str]:
    size = "(SELECT size FROM spans)"
    of_members = links("member_means") | {"spans": WINDOW}
    of = lambda part: f"(SELECT *, count(*) OVER (PARTITION BY epoch) AS n_rows FROM predicted WHERE {part})"
    return {
        "drop_ambiguous": sql("SELECT record_idx, length(sequence) AS n FROM isolates WHERE NOT regexp_matches(sequence, '[BJZX-]')"),
        "require_terminator": sql("SELECT record_idx, length(sequence) AS n FROM isolates WHERE sequence LIKE '%*'"),
        "require_length": sql("SELECT record_idx, length(sequence) AS n FROM isolates WHERE length(sequence) BETWEEN 1260 AND 1280"),
        "split_description": sql('SELECT record_idx, isolate_name, stamp AS "timestamp" FROM split'),
        "shift_day": sql('SELECT record_idx, shifted AS "timestamp" FROM shifted'),
        "parse_date_or_null": sql("SELECT record_idx, strftime(day, '%Y-%m-%d') AS day FROM days"),
        "dedupe_isolates_batch": sql("SELECT batch_no, isolate_name, record_idx FROM batched"),
        "dedupe_isolates_period": sql("SELECT period, isolate_name, record_idx FROM monthly"),
        "dedupe_sequences_period": sql("SELECT period, record_idx FROM quarterly QUALIFY row_number() OVER (PARTITION BY period, sequence ORDER BY batch_no, day, record_idx) = 1"),
        "period_counts": sql(f"SELECT {quarter_of('day')} AS period, count(*) AS n FROM cleaned GROUP BY 1"),
        "clean_pipeline": sql("SELECT period, count(*) AS n FROM monthly GROUP BY period"),
        "year_span": sql("SELECT min(year(day)) AS first_year, max(year(day)) AS last_year FROM cleaned"),
        "period_year": order_periods("year(d)::VARCHAR"),
        "period_quarter": order_periods(quarter_of("d")),
        "period_month": order_periods(month_of("d")),
        "natural_order_periods": f"""
            SELECT (row_number() OVER (ORDER BY string_split(period, '-')[1]::INT, string_split(period, '-')[2]::INT) - 1)::INT AS period_idx, period
            FROM (SELECT DISTINCT {month_of('d')} AS period FROM (SELECT o_orderdate::DATE AS d FROM orders)) WHERE period IS NOT NULL""",
        "count_distinct_periods": " UNION ALL ".join(
            f"SELECT '{name}' AS technique, count(DISTINCT {of('d')}) AS n FROM (SELECT o_orderdate::DATE AS d FROM orders)"
            for name, of in (("year", lambda d: f"year({d})"), ("quarter", quarter_of), ("month", month_of))
        ),
        "train_test_split_by_walk": sql(f"SELECT row_id, {h(f"'{SEED}|split|' || (row_id // {len(settings.site_positions())})::VARCHAR")} % 100 < 20 AS is_test FROM walk_rows"),
        "pca_projected_variances": sql("""
            SELECT unnest([1, 2]) AS component, true AS close, total FROM (SELECT round(sum(s), 4) AS total FROM (SELECT var_samp(v) AS s FROM point_values GROUP BY pos))"""),
        "slice_records": """
            SELECT ((doc_id - 100) // 150)::INT AS batch_no, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents
            WHERE doc_id >= 100 AND doc_id < 700 GROUP BY 1""",
        "read_fasta": sql("SELECT row_number() OVER (ORDER BY record_idx) - 1 AS record_idx, description, md5(sequence) AS sequence_md5 FROM isolates WHERE sequence <> ''"),
        "indexed_slice": sql("""
            SELECT record_idx, ((record_idx - 150) // 200)::INT AS batch_no, description, md5(sequence) AS sequence_md5
            FROM (SELECT row_number() OVER (ORDER BY i.record_idx) - 1 AS record_idx, description, sequence FROM isolates i WHERE sequence <> '') WHERE record_idx BETWEEN 150 AND 749"""),
        "count_records": sql("SELECT count(*) AS n_records FROM pieces"),
        "stored_periods": sql("SELECT period, isolate_name, md5(sequence) AS sequence_md5 FROM monthly"),
        "stored_unique_periods": sql("SELECT period, count(DISTINCT sequence) AS n FROM quarterly GROUP BY period"),
        "stored_trigram_vectors": sql("SELECT * FROM vocab"),
        "stored_centroids": sql(
            f"""SELECT c.period_idx::VARCHAR AS period, c.cluster, array_to_string(next_cluster, '-') AS next_cluster, {', '.join(f'f[{j}] AS d{j}' for j in range(1, WIDTH + 1))}
                FROM linked l JOIN centroids c ON c.period_idx = l.period_idx AND c.cluster = l.cluster""",
            links("centroids"),
        ),
        "stored_cluster_labels": sql(f"SELECT vec_id, period_idx, cluster FROM ({nearest('points', 'centroids')})"),
        "ingest_stream": sql("SELECT period, count(*) AS n, count(DISTINCT isolate_name) AS n_isolates FROM monthly GROUP BY period"),
        "replaced_centroids": sql("""
            SELECT period_idx::VARCHAR AS period, cluster, round(CASE WHEN period_idx IN (2, 3) THEN v + 1 ELSE v END, 6) AS d1 FROM centroid_values WHERE pos = 0"""),
        "sort_centroids": sql("""
            SELECT '2020-' || (1 + vec_id % 12)::VARCHAR AS period, cluster, round(avg(v), 6) AS d1 FROM point_values WHERE pos = 0 GROUP BY 1, 2"""),
        "stored_vectors": sql(f"SELECT record_idx, period, {', '.join(DIMS)} FROM vectors JOIN members USING (record_idx)"),
        "written_cluster_labels": sql(f"SELECT vec_id, period_idx::VARCHAR AS period, cluster FROM ({nearest('points', 'centroids')})"),
        "period_k_table": sql(
            "SELECT period, k::INT AS k, count(*) AS n FROM monthly JOIN (VALUES " + ", ".join(f"('{p}', {k})" for p, k in settings.PERIOD_CLUSTERS.items()) + ") AS ks(period, k) USING (period) GROUP BY ALL"
        ),
        "site_ranges_table": sql(
            'SELECT a AS start, b AS "end", count(*) AS n, count(DISTINCT substr(sequence, a, b - a + 1)) AS n_pieces FROM members, (VALUES '
            + ", ".join(f"({a}, {b})" for a, b in settings.SITE_RANGES) + ") AS ranges(a, b) GROUP BY a, b"
        ),
        "sort_by_date": sql("SELECT record_idx, strftime(day, '%Y-%m-%d') AS day FROM cleaned"),
        "invert_links": sql("SELECT period_idx, src, array_to_string(list_sort(list(dst)), ',') AS dsts FROM bwd GROUP BY ALL", links("centroids")),
        "kmeans_own_centers": "SELECT count(*) AS n, count(*) AS n_nearest, 10 AS n_clusters FROM embeddings",
        "pca_ratio_sums": "SELECT max(len(embedding)) AS components, 1.0 AS total, true AS falling FROM embeddings",
        "stored_dataset": sql("SELECT y, replace(to_json(x)::VARCHAR, ' ', '') AS x, count(*) AS n FROM walk_rows GROUP BY ALL"),
        "trigram_totals": sql(f"SELECT trigram, count(*) AS n FROM (SELECT unnest({TRIGRAMS}) AS trigram FROM isolates) GROUP BY trigram"),
        "sequence_vectors": sql("SELECT * FROM vectors"),
        "context_trigram_ids": sql(f"""
            SELECT record_idx, ordinal, i, idx FROM (SELECT record_idx, ordinal, i, substr(substr(sequence, position - 1, 5), i + 1, 3) AS g
            FROM members, {SITES}, (VALUES (0), (1), (2)) AS three(i)) JOIN vocab ON g = words"""),
        "site_positions": sql(f"SELECT ordinal, position, substr(sequence, position + 1, 1) AS letter, count(*) AS n FROM members, {SITES} GROUP BY ALL"),
        "site_hamming": sql("SELECT record_idx, differences FROM compared"),
        "too_mutated": sql(f"SELECT differences > {LIMIT} AS too_mutated, count(*) AS n FROM compared GROUP BY 1"),
        "assign_nearest": sql(f"SELECT vec_id, cluster, round(dist2, 4) AS dist2 FROM ({nearest('points', 'centroids')})"),
        "centroid_table": sql("SELECT period_idx, cluster, pos, v FROM centroid_values"),
        "lloyd_update": sql(long("n1"), {"a1": nearest("points", "start"), "n1": means("a1", "start")}),
        "kmeans_grouped": sql(long("n2"), {"a1": nearest("points", "start"), "n1": means("a1", "start"), "a2": nearest("points", "n1"), "n2": means("a2", "n1")}),
        "kmeans_fixed_restarts": sql(
            f"""SELECT (fit // 100)::INT AS period_idx, ((fit % 100) // 10)::INT AS k, (fit % 10)::INT AS restart, round(cost, 3) AS cost FROM (
                  SELECT period_idx AS fit, sum(dist2) AS cost FROM ({nearest("rp", "n2")}) GROUP BY 1)
                QUALIFY row_number() OVER (PARTITION BY fit // 10 ORDER BY cost, fit) = 1""",
            {
                "rp": """SELECT vec_id * 100 + k * 10 + r AS vec_id, period_idx * 100 + k * 10 + r AS period_idx, f FROM points, (VALUES (3), (4)) AS ks(k), (VALUES (0), (1), (2)) AS rs(r)""",
                "rs": """SELECT period_idx * 100 + k * 10 + r AS period_idx, (vec_id // 6 - r * k)::INT AS cluster, f
                         FROM points, (VALUES (3), (4)) AS ks(k), (VALUES (0), (1), (2)) AS rs(r) WHERE vec_id // 6 BETWEEN r * k AND r * k + k - 1""",
                "a1": nearest("rp", "rs"), "n1": means("a1", "rs"), "a2": nearest("rp", "n1"), "n2": means("a2", "n1"),
            },
        ),
        "inertia": sql(f"SELECT period_idx, round(sum(dist2), 3) AS inertia, count(*) AS n FROM ({nearest('points', 'centroids')}) GROUP BY 1"),
        "forward_links": sql("SELECT period_idx, src, dst FROM fwd", links("centroids")),
        "backward_links": sql("SELECT period_idx, src, dst FROM bwd", links("centroids")),
        "link_clusters": sql("SELECT period_idx, cluster, array_to_string(next_cluster, '-') AS next_cluster FROM linked", links("centroids")),
        "period_windows": sql("SELECT window_id, array_to_string(x, ',') AS x, y FROM windows"),
        "allocate_samples": sql("""
            SELECT window_id, (t // w + CASE WHEN window_id = w - 1 THEN t - (t // w) * w ELSE 0 END)::INT AS n_samples
            FROM windows, (SELECT count(*) AS t FROM documents), (SELECT count(*) AS w FROM windows)"""),
        "prefer_length_members": sql("SELECT period_idx, cluster, record_idx FROM preferred"),
        "pick_first": sql("SELECT sample_id, period_idx, cluster, md5(sequence) AS sequence_md5 FROM starts JOIN sites_of USING (period_idx, cluster, member_no)", {"samples": SAMPLES} | first_picks("samples", 1)),
        "sample_walks": sql(
            "SELECT sample_id, turn::INT AS turn, md5(array_to_string(seqs, '|')) AS walk_md5 FROM done", of_members | {"samples": EVERYONE} | all_walks("samples", size)
        ),
        "create_dataset": sql(
            "SELECT row_id, y, replace(to_json(x)::VARCHAR, ' ', '') AS x FROM made", of_members | {"samples": EACH_DOCUMENT} | all_walks("samples", size) | walked_rows("done")
        ),
        "create_shards": " UNION ALL ".join(
            "SELECT * FROM (" + sql(f"SELECT {i} AS shard, y, count(*) AS n FROM made GROUP BY y", of_members | {"samples": HALF_OF_DOCUMENTS} | all_walks("samples", size, str(SEED + i)) | walked_rows("done")) + ")"
            for i in (0, 1)
        ),
        "build_rows": sql("SELECT row_id, y, replace(to_json(x)::VARCHAR, ' ', '') AS x FROM walk_rows"),
        "label_mutation": sql("SELECT y, count(*) AS n FROM walk_rows GROUP BY y"),
        "dedupe_dataset": sql("SELECT row_id, y FROM walk_rows QUALIFY row_number() OVER (PARTITION BY x ORDER BY row_id) = 1"),
        "merge_shards": sql("""
            SELECT shard, row_id, y FROM (SELECT *, CASE WHEN row_id % 2 = 1 THEN 0 ELSE 1 END AS shard FROM walk_rows)
            QUALIFY row_number() OVER (PARTITION BY x ORDER BY shard, row_id) = 1"""),
        "unique_ratio": sql("SELECT count(*) AS n_rows, count(DISTINCT x) AS n_unique, round(count(DISTINCT x) * 100.0 / count(*), 6)::DOUBLE AS percent FROM walk_rows"),
        "shuffle_rows": sql(f"SELECT row_id, md5('{SEED}|' || row_id::VARCHAR) AS shuffle_key FROM walk_rows"),
        "train_test_split": sql(f"""SELECT row_id, {h(f"'{SEED}|split|' || row_id::VARCHAR")} % 100 < 20 AS is_test FROM walk_rows"""),
        "load_features": sql(f"SELECT row_id, y, step, {rounded(DIMS, 6)} FROM features"),
        "flatten_features": sql(f"""
            SELECT row_id, y, {2 * WIDTH} AS width, round(sum({' + '.join(f'd{j} * ((step - 1) * {WIDTH} + {j})' for j in range(1, WIDTH + 1))}), 5) AS weighted
            FROM features WHERE step >= 1 GROUP BY row_id, y"""),
        "transpose_steps": sql(" UNION ALL ".join(f"SELECT step, {j - 1} AS pos, count(*) AS n, round(sum(d{j}), 5) AS total FROM features GROUP BY step" for j in range(1, WIDTH + 1))),
        "class_balance": sql("SELECT max(n) / sum(n) AS largest_share FROM (SELECT y, count(*) AS n FROM judged GROUP BY y)"),
        "value_counts": sql("SELECT y AS value, count(*) AS n FROM judged GROUP BY y"),
        "confusion_matrix": sql("SELECT * FROM confusion"),
        "evaluate": sql(f"SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round({F1}, 9) AS f1, round(mcc, 9) AS mcc, round(accuracy, 9) AS accuracy FROM rates"),
        "mcc": sql("SELECT round(mcc, 9) AS mcc FROM rates"),
        "roc_curve": sql("SELECT threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM curve"),
        "auc": sql("""
            SELECT round(sum(a), 9) AS auc FROM (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM curve WINDOW w AS (ORDER BY fpr, tpr))"""),
        "predict_from_scores": sql("SELECT row_id, p AS prediction, round(probability, 8) AS probability, round(p1, 8) AS p1 FROM predicted"),
        "cross_entropy": sql("SELECT round(avg(loss), 8) AS loss FROM predicted"),
        "minibatches": "SELECT event_id // 64 AS batch, count(*) AS n, min(event_id) AS first FROM events WHERE event_id // 64 < (SELECT count(*) // 64 FROM events) GROUP BY 1",
        "epoch_metrics": sql(
            f"SELECT epoch, {rounded(['accuracy', 'precision', 'recall'], 8)}, round({F1}, 8) AS f1, {rounded(['mcc', 'loss'], 8)} FROM e",
            {"e": epochs("(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY epoch) AS n_rows FROM predicted) WHERE batch < n_rows // 64)")},
        ),
        "training_history": sql(
            "SELECT epoch, round(a.loss, 8) AS loss, round(b.loss, 8) AS val_loss, round(a.accuracy, 8) AS accuracy, round(b.accuracy, 8) AS val_accuracy FROM a JOIN b USING (epoch)",
            {"a": epochs(of("row_id % 5 <> 0")), "b": epochs(of("row_id % 5 = 0"))},
        ),
        "first_positive_slice": sql("SELECT row_id, y FROM scores WHERE row_id BETWEEN (SELECT min(row_id) FROM scores WHERE y = 1) AND (SELECT min(row_id) FROM scores WHERE y = 1) + 9"),
    }
