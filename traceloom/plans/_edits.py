"""SQL views of edit operations, for the twins of queries over reads that differ from their ground truths by one edit at most.

Such a pair's only operation is known from the lengths and from how long the ends stay equal: operations are walked back from the ends, and a
kept base comes before any other step."""

from __future__ import annotations

from ..sources.fixture import VIEWS

#: ed: one row an operation; cluster_id, read_no, gt, op, pos, old, new.
EDITS = f"""{VIEWS},
su AS (SELECT cluster_id, read_no, gt, read, coalesce(list_position(list_transform(range(1, least(length(gt), length(read)) + 1),
    lambda i: substr(gt, cast(length(gt) + 1 - i AS int), 1) = substr(read, cast(length(read) + 1 - i AS int), 1)), false) - 1, least(length(gt), length(read))) AS kept FROM rd WHERE read <> gt),
ek AS (SELECT *, CASE WHEN length(read) = length(gt) THEN 'sub' WHEN length(read) < length(gt) THEN 'del' ELSE 'ins' END AS op,
    cast(length(gt) - kept - CASE WHEN length(read) > length(gt) THEN 0 ELSE 1 END AS int) AS pos FROM su),
ed AS (SELECT cluster_id, read_no, gt, op, pos, CASE WHEN op <> 'ins' THEN substr(gt, pos + 1, 1) END AS old, CASE WHEN op <> 'del' THEN substr(read, pos + 1, 1) END AS new FROM ek)"""

#: hp: runs of three or more equal bases of the ground truths. cl: ed with the effect on the first run that is touched.
CLASSES = f"""{EDITS},
hb AS (SELECT gt_id, pos, substr(gt, cast(pos + 1 AS int), 1) AS base FROM (SELECT gt_id, gt, unnest(range(0, length(gt))) AS pos FROM gt)),
hp AS (SELECT gt_id AS cluster_id, base, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT *, pos - row_number() OVER (PARTITION BY gt_id, base ORDER BY pos) AS isle FROM hb) GROUP BY gt_id, base, isle HAVING count(*) >= 3),
ef AS (SELECT ed.cluster_id, read_no, op, s, e - s AS size, CASE
    WHEN op = 'ins' AND new = base AND pos BETWEEN s - 1 AND e THEN 'hp_expansion' WHEN op = 'del' AND pos >= s AND pos < e THEN 'hp_contraction'
    WHEN pos >= s AND pos < e THEN 'hp_interruption' WHEN op <> 'del' AND pos IN (s - 1, e) THEN 'hp_boundary' END AS effect FROM ed LEFT JOIN hp ON hp.cluster_id = ed.cluster_id),
cl AS (SELECT cluster_id, read_no, op, coalesce(min_by(effect, s) FILTER (WHERE effect IS NOT NULL), 'non_hp') AS hp_class, min_by(size, s) FILTER (WHERE effect IS NOT NULL) AS hp_length FROM ef GROUP BY ALL)"""

RATES = f"""{EDITS}, b AS (SELECT sum(length(gt)) AS bases FROM rd), c AS (SELECT count(*) FILTER (WHERE op = 'sub') AS sub, count(*) FILTER (WHERE op = 'del') AS del, count(*) FILTER (WHERE op = 'ins') AS ins FROM ed),
k AS (SELECT 'match' AS op, bases - sub - del AS n FROM b, c UNION ALL SELECT 'sub', sub FROM c UNION ALL SELECT 'del', del FROM c UNION ALL SELECT 'ins', ins FROM c)
SELECT op, cast(n AS bigint) AS n, round(n / bases, 6) AS rate FROM k, b"""

_BINS = "SELECT *, 'place' AS scale, cast(p AS varchar) AS bin FROM {0} UNION ALL SELECT *, 'tenth', cast(cast(least(floor(p / n * 10), 9) AS int) AS varchar) FROM {0} UNION ALL SELECT *, 'third', CASE WHEN p / n < 0.2::double THEN 'start' WHEN p / n > 0.8::double THEN 'end' ELSE 'middle' END FROM {0}"

PROFILE = f"""{EDITS}, ln AS (SELECT length(gt) AS n, count(*) AS w FROM rd GROUP BY 1), pl AS (SELECT w, n, unnest(range(0, n)) AS p FROM ln),
ba AS (SELECT scale, bin, cast(sum(w) AS bigint) AS bases FROM ({_BINS.format('pl')}) GROUP BY ALL),
oa AS (SELECT length(gt) AS n, least(pos, length(gt) - 1) AS p, unnest([op, 'all']) AS op FROM ed),
oc AS (SELECT op, scale, bin, count(*) AS n FROM ({_BINS.format('oa')}) GROUP BY ALL),
t AS (SELECT op, sum(n) AS all_n, (SELECT sum(n * w) FROM ln) AS all_bases FROM oc WHERE scale = 'third' GROUP BY op)
SELECT op, scale, bin, n, bases, round(n / bases, 6) AS rate, round((n / bases) / (all_n / all_bases), 6) AS enrichment, (n / bases) / (all_n / all_bases) < 0.5 AS low FROM oc JOIN ba USING (scale, bin) JOIN t USING (op)"""

#: The chance of so many or more by the sum of all chances from there on, through the logarithm of the gamma function.
TOUCHING = f"""{CLASSES}, w AS (SELECT cluster_id, count(*) AS w FROM rd GROUP BY 1),
sh AS (SELECT (SELECT sum((e - s) * w) FROM hp JOIN w USING (cluster_id)) / (SELECT sum(length(gt)) FROM rd) AS q),
h AS (SELECT op, count(*) AS n, count(*) FILTER (WHERE hp_class <> 'non_hp') AS k FROM cl GROUP BY op)
SELECT op, n AS operations, k AS touching, round(q, 6) AS share, round(k / n / q, 6) AS enrichment,
    round(least(1, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(q) + (n - i) * ln(1 - q))))), 6) AS p FROM h, sh"""

LENGTHS = f"""{CLASSES}, w AS (SELECT cluster_id, count(*) AS w FROM rd GROUP BY 1), u AS (SELECT e - s AS length, cast(sum(w) AS bigint) AS runs FROM hp JOIN w USING (cluster_id) GROUP BY 1),
c AS (SELECT hp_length AS length, hp_class, count(*) AS n FROM cl WHERE hp_class <> 'non_hp' GROUP BY ALL)
SELECT length, runs, coalesce(hp_class, 'none') AS hp_class, coalesce(n, 0) AS n FROM u LEFT JOIN c USING (length)"""
