"""Pieces of reference SQL shared by the query modules."""

from __future__ import annotations

_FIRST = "{v} AS (SELECT * FROM {t} WHERE {k} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY collected_at) = 1)"
Q = _FIRST.format(v="q", t="questions", k="question_id")
A = _FIRST.format(v="a", t="answers", k="answer_id")
C = _FIRST.format(v="c", t="comments", k="comment_id")
U = _FIRST.format(v="u", t="users", k="user_id")


def year(epoch: str) -> str:
    """UTC year of epoch seconds."""
    return f"CAST(year(make_timestamp({epoch} * 1000000)) AS INTEGER)"


def month(epoch: str) -> str:
    """'YYYY-MM' of epoch seconds."""
    return f"strftime(make_timestamp({epoch} * 1000000), '%Y-%m')"


JUDGED = f"""j AS (SELECT q.owner_user_id AS asker, a.owner_user_id AS answerer, {year("a.creation_date")} AS year FROM a LEFT JOIN q USING (question_id)),
  jj AS (SELECT *, CASE WHEN asker IS NULL OR answerer IS NULL THEN 'missing' WHEN asker = 0 OR answerer = 0 THEN 'excluded' WHEN asker = answerer THEN 'self'
                        WHEN year IS NULL OR year NOT BETWEEN 2021 AND 2026 THEN 'year' ELSE 'kept' END AS reason FROM j)"""
EDGES = f"{Q}, {A}, {JUDGED}, e AS MATERIALIZED (SELECT asker AS src, answerer AS dst, count(*) AS weight FROM jj WHERE reason = 'kept' GROUP BY 1, 2)"
YEAR_EDGES = f"{Q}, {A}, {JUDGED}, e AS MATERIALIZED (SELECT year, asker AS src, answerer AS dst, count(*) AS weight FROM jj WHERE reason = 'kept' GROUP BY 1, 2, 3)"
NODES = "n AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"


def pagerank(steps: int = 120, alpha: float = 0.85) -> str:
    """CTEs after EDGES and NODES in a WITH RECURSIVE; the last is ``pr(id, rank, c)`` after so many steps that nothing changes any more."""
    return f"""o AS MATERIALIZED (SELECT src, sum(weight) AS s FROM e GROUP BY 1), cnt AS MATERIALIZED (SELECT count(*) AS c FROM n),
  pl(step, id, rank) AS (SELECT 0, id, 1.0 / c FROM n, cnt UNION ALL
    SELECT step + 1, pl.id, {alpha} * (coalesce(f, 0) + l / c) + {1 - alpha} / c FROM pl CROSS JOIN cnt
      CROSS JOIN (SELECT coalesce(sum(z.rank), 0) AS l FROM pl z LEFT JOIN o ON o.src = z.id WHERE o.src IS NULL) d
      LEFT JOIN (SELECT e.dst, sum(r.rank * e.weight / o.s) AS f FROM e JOIN o ON e.src = o.src JOIN pl r ON r.id = e.src GROUP BY 1) x ON x.dst = pl.id WHERE step < {steps}),
  pr AS MATERIALIZED (SELECT id, rank, c FROM pl, cnt WHERE step = {steps})"""


def yearly_pagerank(steps: int = 120, alpha: float = 0.85) -> str:
    """CTEs after YEAR_EDGES in a WITH RECURSIVE; the last is ``pr(year, id, rank, c)``."""
    return f"""n AS MATERIALIZED (SELECT year, src AS id FROM e UNION SELECT year, dst FROM e),
  o AS MATERIALIZED (SELECT year, src, sum(weight) AS s FROM e GROUP BY 1, 2), cnt AS MATERIALIZED (SELECT year, count(*) AS c FROM n GROUP BY 1),
  pl(step, year, id, rank) AS (SELECT 0, year, id, 1.0 / c FROM n JOIN cnt USING (year) UNION ALL
    SELECT step + 1, pl.year, pl.id, {alpha} * (coalesce(f, 0) + coalesce(l, 0) / c) + {1 - alpha} / c FROM pl JOIN cnt ON cnt.year = pl.year
      LEFT JOIN (SELECT z.year, sum(z.rank) AS l FROM pl z LEFT JOIN o ON o.year = z.year AND o.src = z.id WHERE o.src IS NULL GROUP BY 1) d ON d.year = pl.year
      LEFT JOIN (SELECT e.year, e.dst, sum(r.rank * e.weight / o.s) AS f FROM e JOIN o ON e.src = o.src AND e.year = o.year JOIN pl r ON r.id = e.src AND r.year = e.year GROUP BY 1, 2) x
        ON x.dst = pl.id AND x.year = pl.year WHERE step < {steps}),
  pr AS MATERIALIZED (SELECT year, id, rank, c FROM pl JOIN cnt USING (year) WHERE step = {steps})"""


def eigenvector(steps: int = 400) -> str:
    """CTEs after EDGES and NODES in a WITH RECURSIVE; the last is ``eig(id, score)``."""
    return f"""el(step, id, s) AS (SELECT 0, id, 1.0::DOUBLE FROM n UNION ALL
    SELECT step + 1, id, s / max(s) OVER () FROM (SELECT el.step, el.id, el.s + coalesce(f, 0) AS s FROM el
      LEFT JOIN (SELECT dst, sum(z.s * weight) AS f FROM e JOIN el z ON z.id = src GROUP BY 1) x ON x.dst = el.id) WHERE step < {steps}),
  eig AS (SELECT id, s AS score FROM el WHERE step = {steps})"""


def katz(steps: int = 80, alpha: float = 0.005, beta: float = 1.0) -> str:
    """CTEs after EDGES and NODES in a WITH RECURSIVE; the last is ``kz(id, score)``."""
    return f"""kl(step, id, s) AS (SELECT 0, id, 0.0::DOUBLE FROM n UNION ALL
    SELECT step + 1, kl.id, {alpha} * coalesce(f, 0) + {beta} FROM kl LEFT JOIN (SELECT dst, sum(z.s * weight) AS f FROM e JOIN kl z ON z.id = src GROUP BY 1) x ON x.dst = kl.id WHERE step < {steps}),
  kz AS (SELECT id, s AS score FROM kl WHERE step = {steps})"""


def hits(steps: int = 120) -> str:
    """CTEs after EDGES and NODES in a WITH RECURSIVE; the last is ``ht(id, authority, hub)``."""
    auth = "(SELECT n.id, coalesce(f, 0) AS a FROM n LEFT JOIN (SELECT dst, sum(z.h * weight) AS f FROM e JOIN hl z ON z.id = src GROUP BY 1) x ON x.dst = n.id)"
    return f"""hl(step, id, a, h) AS (SELECT 0, id, 1.0::DOUBLE, 1.0::DOUBLE FROM n UNION ALL
    SELECT step + 1, id, a / max(a) OVER (), h / max(h) OVER () FROM (SELECT hl.step, hl.id, y.a, coalesce(g, 0) AS h FROM hl JOIN {auth} y ON y.id = hl.id
      LEFT JOIN (SELECT src, sum(w.a * weight) AS g FROM e JOIN {auth} w ON w.id = dst GROUP BY 1) v ON v.src = hl.id) WHERE step < {steps}),
  ht AS (SELECT id, a AS authority, h AS hub FROM hl WHERE step = {steps})"""


# shortest paths with their numbers, then closeness and harmonic over incoming paths, and betweenness from sampled sources
PATHS = """bfs(s, v, d, p) USING KEY (s, v) AS (SELECT id, id, 0, 1.0::DOUBLE FROM n UNION ALL
    SELECT w.s, e.dst, w.d + 1, sum(w.p) FROM bfs w JOIN e ON e.src = w.v LEFT JOIN recurring.bfs r ON r.s = w.s AND r.v = e.dst WHERE r.s IS NULL GROUP BY 1, 2, 3),
  dist AS MATERIALIZED (SELECT * FROM bfs),
  near AS (SELECT v AS id, sum(1.0 / d) AS harmonic, (count(*) / ((SELECT count(*) FROM n) - 1)) * (count(*) / sum(d)) AS closeness FROM dist WHERE d > 0 GROUP BY 1),
  cl AS (SELECT n.id, coalesce(closeness, 0) AS closeness, coalesce(harmonic, 0) AS harmonic FROM n LEFT JOIN near USING (id)),
  smp AS (SELECT id FROM n ORDER BY md5(CAST(id AS VARCHAR)) LIMIT 500),
  dep AS (SELECT a.v AS id, sum(a.p * b.p / t.p) AS b FROM dist a JOIN smp ON smp.id = a.s JOIN dist b ON b.s = a.v JOIN dist t ON t.s = a.s AND t.v = b.v
    WHERE a.d > 0 AND b.d > 0 AND a.d + b.d = t.d GROUP BY 1),
  bt AS (SELECT n.id, coalesce(b, 0) AS score FROM n LEFT JOIN dep USING (id))"""


# one answer per line item; every answer is a practice of a camp, or of none on line 6; taxed ones are said twice
PRACTICES = """ln AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS answer_id,
       lineitem.*, o_custkey AS group_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  p0 AS (SELECT group_id, answer_id * 2 AS ext_id, answer_id, CASE WHEN l_linenumber <> 6 THEN CAST(ascii(l_returnflag) * 256 + ascii(l_linestatus) AS BIGINT) END AS camp_id,
       CAST(l_quantity - 10 AS BIGINT) AS vote, CASE WHEN l_linenumber <> 7 THEN l_suppkey END AS author_id,
       CAST(CASE l_returnflag WHEN 'A' THEN 0.9 WHEN 'N' THEN 0.5 ELSE 0.7 END AS DOUBLE) AS agreement, 'part ' || l_partkey AS sentence, l_tax FROM ln),
  p AS (SELECT * EXCLUDE (l_tax) FROM p0 UNION ALL SELECT group_id, ext_id + 1, answer_id, camp_id, vote, author_id, agreement, sentence || ' again' FROM p0 WHERE l_tax > 0.04),
  au AS (SELECT s_suppkey AS author_id, s_acctbal AS pr, s_name AS name FROM supplier)"""
CAMPS = """ca AS (SELECT group_id, camp_id, answer_id, max(greatest(vote, 0)) AS v, min(ext_id) AS e, max(agreement) AS g FROM p WHERE camp_id IS NOT NULL GROUP BY 1, 2, 3),
  cv AS (SELECT group_id, camp_id, min(e) AS first_ext, count(*) AS prevalence_n, CAST(sum(v) AS BIGINT) AS vote_sum, max(g) AS agreement FROM ca GROUP BY 1, 2),
  cs AS (SELECT *, coalesce(vote_sum / nullif(CAST(sum(vote_sum) OVER (PARTITION BY group_id) AS BIGINT), 0), 0.0) AS vote_share FROM cv),
  cr AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY vote_share DESC, first_ext, camp_id) AS rn, row_number() OVER (PARTITION BY group_id ORDER BY prevalence_n DESC, first_ext, camp_id) AS pn FROM cs)"""
PRIMARY = """pc0 AS (SELECT group_id, author_id, camp_id, count(*) AS f, max({'v': greatest(vote, 0), 'e': -ext_id}) AS b FROM p WHERE camp_id IS NOT NULL AND author_id IS NOT NULL GROUP BY 1, 2, 3),
  pc AS (SELECT group_id, author_id, camp_id FROM pc0 QUALIFY row_number() OVER (PARTITION BY group_id, author_id ORDER BY b.v DESC, f DESC, b.e DESC) = 1),
  known AS (SELECT * FROM au WHERE pr > 0),
  ra AS (SELECT group_id, author_id, pr, name, row_number() OVER (PARTITION BY group_id ORDER BY pr DESC, author_id) AS place FROM (SELECT DISTINCT group_id, author_id FROM p WHERE author_id IS NOT NULL) JOIN known USING (author_id)),
  tot AS (SELECT group_id, sum(pr) AS pr_total FROM pc JOIN known USING (author_id) GROUP BY 1)"""


def shape(top1: str, top2: str) -> str:
    """The label of two shares."""
    return f"CASE WHEN {top1} >= 0.4 AND {top1} - {top2} >= 0.15 THEN 'consensus' WHEN {top1} + {top2} >= 0.6 THEN 'polarization' ELSE 'fragmentation' END"
