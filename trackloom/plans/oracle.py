"""SQL of the tracking queries, for DuckDB over the same tables."""

from __future__ import annotations

import re

def _euclid(a: str = "a", b: str = "b") -> str:
    return f"sqrt(list_sum(list_transform(range(1, len({a}.x) + 1), lambda i: ({b}.x[i] - {a}.x[i]) * ({b}.x[i] - {a}.x[i]))))"


#: Views that several others or a query read more than once, and that are dear.
WRITTEN = {"near", "fars", "fuzz", "vec", "fit", "fitcore", "unrot", "place", "mr3", *(f"{x}{i}" for x in "sce" for i in range(11)), *(f"h{i}" for i in range(4))}

VIEWS = {
    "det": """SELECT vec_id AS linear_ind, CAST(floor(vec_id / 10.0) AS INT) AS t, CAST(vec_id % 10 AS INT) AS raw_neuron_ind,
        CAST(vec_id % 10 + 1 AS INT) AS raw_seg_id, CAST(label + 1 AS INT) AS gt_label, (1 + CAST(embedding[1] AS DOUBLE)) / 2 AS likelihood,
        8 + 8 * CAST(embedding[2] AS DOUBLE) AS z, 64 + 64 * CAST(embedding[3] AS DOUBLE) AS x, 64 + 64 * CAST(embedding[4] AS DOUBLE) AS y FROM embeddings""",
    "gt": """SELECT gt_label AS name, t, raw_neuron_ind, raw_seg_id, linear_ind, likelihood, z, x, y FROM
        (SELECT *, row_number() OVER (PARTITION BY gt_label, t ORDER BY likelihood DESC, linear_ind) rn FROM det) q WHERE rn = 1""",
    "pred": """SELECT CAST(1 + ((name - 1) * 3) % 10 AS INT) AS name, t,
        CASE WHEN linear_ind % 13 = 0 THEN CAST(raw_seg_id % 10 + 1 AS INT) ELSE raw_seg_id END AS raw_seg_id, likelihood
        FROM gt WHERE linear_ind % 11 <> 0""",
    "labelings": """SELECT r AS run, linear_ind, t, CAST(CASE WHEN (linear_ind * 3 + r) % 17 = 0 THEN 1 + (gt_label + r) % 10
        ELSE 1 + (gt_label - 1 + r) % 10 END AS INT) AS label, 0.5 + 0.5 * likelihood AS prob
        FROM det CROSS JOIN (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS r) q WHERE (linear_ind + r) % 7 <> 0""",
    "votes": "SELECT run, linear_ind, t, CAST(1 + (label - 1 - run + 10) % 10 AS INT) AS label FROM labelings",
    "stats": """SELECT user_id AS trial, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos, value AS loss FROM events""",
    "tree": """SELECT CAST(node AS INT) AS node, CAST(CASE WHEN node > 0 THEN (node - 1) // 2 END AS INT) AS parent FROM (SELECT vec_id AS node FROM embeddings
        UNION ALL SELECT vec_id + n FROM embeddings, (SELECT count(*) AS n FROM embeddings) c WHERE vec_id < n - 1) q""",
    "n_frames": "SELECT max(t) + 1 AS n_frames FROM det",
    "aligned": """SELECT g.name, g.t, g.raw_seg_id AS gt_seg, p.raw_seg_id AS pred_seg FROM gt g
        LEFT JOIN pred p ON p.t = g.t AND p.name = 1 + ((g.name - 1) * 3) % 10""",
    "cells": """SELECT name, t, gt_seg, pred_seg, gt_seg IS NOT NULL AS gt_valid, gt_seg IS NOT NULL AND pred_seg IS NULL AS miss,
        coalesce(gt_seg <> pred_seg, false) AS mismatch, coalesce(gt_seg = pred_seg, false) AS correct FROM aligned""",
    "kept": """SELECT gt_label, t, linear_ind FROM (SELECT *, row_number() OVER (PARTITION BY gt_label, t
        ORDER BY linear_ind % 5 = 0, likelihood DESC, linear_ind DESC) rn FROM det) q WHERE rn = 1""",
    "metrics": """SELECT name, CAST(count_if(gt_valid) AS BIGINT) AS num_detections, CAST(count_if(mismatch) AS BIGINT) AS num_mismatches,
        CAST(count_if(miss) AS BIGINT) AS num_misses, CAST(max(n_frames) - count(pred_seg) AS BIGINT) AS gaps, max(n_frames) AS n_frames
        FROM cells, n_frames GROUP BY name""",
    "rated": """SELECT name, num_detections, num_mismatches, num_misses, gaps, CAST(gaps AS DOUBLE) / n_frames AS frac_gaps,
        100 * (1 - CAST(gaps AS DOUBLE) / n_frames) AS pct_tracked, num_mismatches + num_misses AS mistakes,
        1 - CAST(num_mismatches + num_misses AS DOUBLE) / num_detections AS accuracy,
        CAST(num_mismatches + num_misses AS DOUBLE) / n_frames AS frac_mistakes FROM metrics""",
    "no_gt": """SELECT name, CAST(max(n_frames) - count(raw_seg_id) AS BIGINT) AS gaps,
        CAST(max(n_frames) - count(raw_seg_id) AS DOUBLE) / max(n_frames) AS frac_gaps,
        100 * (1 - CAST(max(n_frames) - count(raw_seg_id) AS DOUBLE) / max(n_frames)) AS pct_tracked FROM pred, n_frames GROUP BY name""",
    "vec": "SELECT vec_id AS linear_ind, CAST(floor(vec_id / 10.0) AS INT) AS t, label + 1 AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings",
    "near": """SELECT src, dst, dist, rk FROM (SELECT a.linear_ind AS src, b.linear_ind AS dst, list_distance(a.x, b.x) AS dist,
        row_number() OVER (PARTITION BY a.linear_ind ORDER BY dist, b.linear_ind) AS rk FROM vec a, vec b) q WHERE rk <= 10""",
    "fars": """SELECT src, far, mean, coalesce(list_filter(far, lambda d: d > 0)[1], 0) AS rho FROM
        (SELECT src, list_sort(list(dist)) AS far, avg(dist) AS mean FROM near WHERE src <> dst GROUP BY src) q""",
    "fuzz": """SELECT n.src, n.dst, CASE WHEN dist <= rho OR sigma = 0 THEN 1 ELSE exp(-(dist - rho) / sigma) END AS w FROM near n JOIN (SELECT src, rho, greatest(mid, mean / 1000) AS sigma FROM
        (WITH RECURSIVE b(src, i, lo, hi, mid) AS (SELECT src, 0, 0.0::DOUBLE, 'inf'::DOUBLE, 1.0::DOUBLE FROM fars UNION ALL
        SELECT src, i + 1, lo, hi, CASE WHEN hi = 'inf'::DOUBLE THEN mid * 2 ELSE (lo + hi) / 2 END FROM (SELECT b.src, i, CASE WHEN s > goal THEN lo ELSE mid END AS lo, CASE WHEN s > goal THEN mid ELSE hi END AS hi, mid FROM
            (SELECT b.*, log2(len(far) + 1) AS goal, list_sum(list_transform(far, lambda d: exp(-greatest(d - rho, 0) / mid))) AS s FROM b JOIN fars USING (src) WHERE i < 64) b) c)
        SELECT src, mid FROM b WHERE i = 64) m JOIN fars USING (src)) z ON z.src = n.src WHERE n.src <> n.dst""",
    "seeds": "SELECT t AS run, linear_ind AS node, CAST(row_number() OVER (PARTITION BY t ORDER BY linear_ind) AS INT) AS label FROM det WHERE t IN (0, 3, 6)",
    "loops": "SELECT src, dst FROM near UNION ALL SELECT DISTINCT src, src FROM near",
    "h0": "SELECT run, node, label, CAST(1 AS DOUBLE) AS p FROM seeds",
    **{
        f"h{i}": f"""SELECT run, src AS node, label, sum(p) / CAST(11 AS DOUBLE) AS p FROM loops JOIN h{i - 1} ON node = dst
        WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.run = h{i - 1}.run AND s.node = src) GROUP BY run, src, label
        UNION ALL SELECT run, node, label, CAST(1 AS DOUBLE) FROM seeds"""
        for i in (1, 2, 3)
    },
    "closure": """SELECT anc, node FROM (WITH RECURSIVE cl(anc, node) AS (SELECT node, node FROM tree UNION ALL
        SELECT tree.parent, cl.node FROM cl JOIN tree ON cl.anc = tree.node WHERE tree.parent IS NOT NULL) SELECT anc, node FROM cl) q""",
    "top1": """SELECT run, t, label, linear_ind, prob FROM (SELECT *, row_number() OVER
        (PARTITION BY run, t, label ORDER BY prob DESC, linear_ind) AS rn FROM labelings) q WHERE rn = 1""",
    "unit": "SELECT run, linear_ind, label, prob / coalesce(nullif(sum(prob) OVER (PARTITION BY run, linear_ind), 0), 1) AS val FROM top1",
    "confusion": """SELECT a.label AS ref, b.label AS new, CAST(count(*) AS BIGINT) AS n FROM labelings a JOIN labelings b
        ON a.linear_ind = b.linear_ind AND a.run = 0 AND b.run = 1 GROUP BY ALL""",
    "chosen": "SELECT DISTINCT CAST(floor(i * n_frames / 12) AS INT) AS t FROM n_frames, (SELECT unnest(range(12)) AS i) q",
    "untracked": """SELECT d.linear_ind, CASE WHEN g.name IS NOT NULL THEN printf('neuron_%03d', g.name)
        ELSE printf('untracked_time_%d_%04d_%04d', d.t, d.raw_neuron_ind, d.raw_seg_id) END AS obj_name FROM det d LEFT JOIN gt g USING (linear_ind)""",
    "second_last": """SELECT trial, max(CASE WHEN n >= 2 AND pos = n - 2 THEN loss END) AS val_loss
        FROM (SELECT *, count(*) OVER (PARTITION BY trial) AS n FROM stats) q GROUP BY trial""",
    "core5": "SELECT src AS linear_ind, dist AS core FROM near WHERE rk = 5",
    "core3": f"""SELECT linear_ind, d AS core FROM (SELECT a.linear_ind, {_euclid()} AS d, row_number() OVER (PARTITION BY a.linear_ind ORDER BY {_euclid()}, b.linear_ind) AS rk
        FROM vec a, vec b) q WHERE rk = 3""",
    "mr3": f"""SELECT a.linear_ind AS a, b.linear_ind AS b, greatest({_euclid()}, ca.core, cb.core) AS w FROM vec a JOIN vec b ON a.linear_ind < b.linear_ind
        JOIN core3 ca ON ca.linear_ind = a.linear_ind JOIN core3 cb ON cb.linear_ind = b.linear_ind""",
    # rounds of the least edge of each component: enough for 2^10 points
    "c0": "SELECT linear_ind AS id, linear_ind AS comp FROM vec",
    **{
        k: v
        for i in range(1, 11)
        for k, v in {
            f"e{i}": f"""SELECT comp, min(e) AS e, arg_min(other, e) AS other FROM (SELECT ca.comp, cb.comp AS other, {{'w': w, 'a': a, 'b': b}} AS e FROM mr3
                JOIN c{i - 1} ca ON ca.id = a JOIN c{i - 1} cb ON cb.id = b WHERE ca.comp <> cb.comp UNION ALL SELECT cb.comp, ca.comp, {{'w': w, 'a': a, 'b': b}} FROM mr3
                JOIN c{i - 1} ca ON ca.id = a JOIN c{i - 1} cb ON cb.id = b WHERE ca.comp <> cb.comp) q GROUP BY comp""",
            f"c{i}": f"""SELECT id, coalesce(root, comp) AS comp FROM c{i - 1} LEFT JOIN (WITH RECURSIVE reach(comp, goal) AS (SELECT comp, comp FROM e{i}
                UNION SELECT reach.comp, e{i}.other FROM reach JOIN e{i} ON e{i}.comp = reach.goal) SELECT reach.comp, min(goal) AS root FROM reach
                WHERE goal IN (SELECT x.comp FROM e{i} x JOIN e{i} y ON y.comp = x.other WHERE y.other = x.comp) GROUP BY reach.comp) r USING (comp)""",
        }.items()
    },
    "feat": """SELECT i, j, covar_samp(x[i], x[65 - j]) / (stddev_samp(x[i]) * stddev_samp(x[65 - j])) * (count(*) - 1) / count(*) AS c
        FROM vec, (SELECT unnest(range(1, 65)) AS i) a, (SELECT unnest(range(1, 65)) AS j) b GROUP BY i, j""",
    "objs": """SELECT a.t, a.linear_ind AS i, b.linear_ind AS j, covar_samp(a.x[k], b.x[65 - k])
        / (stddev_samp(a.x[k]) * stddev_samp(b.x[65 - k])) * (count(*) - 1) / count(*) AS c
        FROM vec a JOIN vec b ON a.t = b.t, (SELECT unnest(range(1, 65)) AS k) q GROUP BY a.t, a.linear_ind, b.linear_ind""",
    "noisy": "SELECT linear_ind, t, x, CAST(CASE WHEN linear_ind % 9 = 0 THEN -1 ELSE label END AS INT) AS label FROM vec",
    "fit": "SELECT * FROM noisy WHERE t IN (SELECT t FROM chosen)",
    "fitcore": f"""SELECT linear_ind, d AS core FROM (SELECT a.linear_ind, {_euclid()} AS d, row_number() OVER (PARTITION BY a.linear_ind ORDER BY {_euclid()}, b.linear_ind) AS rk
        FROM fit a, fit b) q WHERE rk = 3""",
    "leaf": "SELECT node AS child, parent, CASE WHEN node >= n - 1 THEN node - n + 1 END AS point FROM tree, (SELECT count(*) AS n FROM embeddings) c",
    "cfg": """SELECT user_id AS trial, CAST(max(CAST(json_extract(props, '$.k') AS BIGINT)) AS VARCHAR) AS k, '/old/run' || user_id AS folder FROM events GROUP BY user_id""",
    "unrot": "SELECT t, linear_ind, label, count(*) AS n FROM votes GROUP BY ALL",
    # the most votes of an assignment: objects one by one, over sets of labels taken
    "place": "SELECT t, linear_ind, row_number() OVER (PARTITION BY t ORDER BY linear_ind) AS k FROM (SELECT DISTINCT t, linear_ind FROM unrot) q",
    "s0": "SELECT DISTINCT t, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS v FROM place",
    **{
        f"s{i}": f"""SELECT t, taken, max(v) AS v FROM (SELECT t, taken, v FROM s{i - 1} UNION ALL
        SELECT s.t, s.taken | (1 << (u.label - 1)), s.v + u.n FROM s{i - 1} s JOIN place p ON p.t = s.t AND p.k = {i}
        JOIN unrot u ON u.t = p.t AND u.linear_ind = p.linear_ind WHERE (s.taken >> (u.label - 1)) & 1 = 0) q GROUP BY t, taken"""
        for i in range(1, 11)
    },
}

COUNTS = """CAST(count_if(gt_valid) AS BIGINT) AS n_gt, CAST(count_if(miss) AS BIGINT) AS misses, CAST(count_if(mismatch) AS BIGINT) AS mismatches"""
ACCURACY = COUNTS + ", round(CAST(count_if(correct) AS DOUBLE) / nullif(count_if(gt_valid), 0), 6) AS accuracy"


def _r(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0.0 AS {name or expression}"


def _bounds(centres: dict[str, str], shape: tuple[int, ...] = (16, 128, 128), target: tuple[int, ...] = (8, 64, 64)) -> str:
    out = []
    for (axis, centre), dim, size in zip(centres.items(), shape, target, strict=True):
        lo = f"greatest(least({centre} - {size // 2}, {dim}), 0)"
        hi = f"least(greatest(least({centre} + {size // 2}, {dim}), 0), {lo} + {size})"
        out.append(f"CAST({lo} AS INT) AS {axis}0, CAST({hi} AS INT) AS {axis}1, CAST(greatest({size} - ({hi} - {lo}), 0) AS INT) AS pad{axis}")
    return ", ".join(out)


def _distance(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.{k} - {b}.{k}) * ({a}.{k} - {b}.{k})" for k in "zxy") + ")"


EDGES = [10 ** (1 + i / 9) for i in range(10)]
EDGES[0], EDGES[-1] = 10.0, 100.0 + 1e-6

BODIES = {
    "align_reindex": "SELECT * FROM aligned",
    "track_contingency": "SELECT g.name AS gt_name, p.name AS pred_name, count(*) AS n FROM gt g JOIN pred p USING (t, raw_seg_id) GROUP BY ALL",
    "combine_first": """SELECT coalesce(a.name, b.name) AS name, coalesce(a.t, b.t) AS t, coalesce(a.raw_seg_id, b.raw_seg_id) AS raw_seg_id
        FROM pred a FULL OUTER JOIN gt b ON a.name = b.name AND a.t = b.t""",
    "mode_vote": """SELECT linear_ind, label, n FROM (SELECT *, row_number() OVER (PARTITION BY linear_ind ORDER BY n DESC, label) rn FROM
        (SELECT linear_ind, label, count(*) AS n FROM votes GROUP BY ALL) a) b WHERE rn = 1""",
    "enrich_tracks": f"SELECT p.name, p.t, d.raw_neuron_ind, {_r('d.z', 'z')}, {_r('d.x', 'x')}, {_r('d.y', 'y')} FROM pred p LEFT JOIN det d USING (t, raw_seg_id)",
    "accuracy_total": f"SELECT {ACCURACY} FROM cells",
    "accuracy_per_neuron": f"SELECT name, {ACCURACY} FROM cells GROUP BY name",
    "bucketed_accuracy": f"SELECT t, {ACCURACY} FROM cells GROUP BY t",
    "accuracy_per_timepoint": f"SELECT t, {ACCURACY} FROM cells GROUP BY t",
    "accuracy_grouping_sets": f"SELECT name, t, {COUNTS} FROM cells GROUP BY GROUPING SETS ((), (name), (t))",
    "accuracy_cells": "SELECT name, t, gt_valid, miss, mismatch, correct FROM cells",
    "track_metrics": f"SELECT name, num_detections, num_mismatches, num_misses, gaps, {_r('frac_gaps')}, {_r('pct_tracked')}, mistakes, {_r('accuracy')}, {_r('frac_mistakes')} FROM rated",
    "track_metrics_no_gt": f"SELECT name, gaps, {_r('frac_gaps')}, {_r('pct_tracked')} FROM no_gt",
    "trace_correlation": f"SELECT name, {_r('corr(likelihood, b)', 'correlation')} FROM gt JOIN (SELECT t, avg(z) AS b FROM det GROUP BY t) q USING (t) GROUP BY name",
    "coverage_histogram": f"""SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, round(coalesce(100.0 * n / sum(n) OVER (), 0), 6) AS pct FROM
        (VALUES {', '.join(f'(CAST({i} AS INT), CAST({EDGES[i]!r} AS DOUBLE), CAST({EDGES[i + 1]!r} AS DOUBLE))' for i in range(9))}) e(bin, lo, hi)
        LEFT JOIN (SELECT bin, count(*) AS n FROM no_gt JOIN (VALUES {', '.join(f'({i}, CAST({EDGES[i]!r} AS DOUBLE), CAST({EDGES[i + 1]!r} AS DOUBLE))' for i in range(9))}) f(bin, lo, hi)
        ON pct_tracked >= lo AND pct_tracked < hi GROUP BY bin) c USING (bin)""",
    "trend_fit": f"SELECT {_r('regr_slope(accuracy, pct_tracked)', 'slope')}, {_r('regr_intercept(accuracy, pct_tracked)', 'intercept')}, {_r('regr_r2(accuracy, pct_tracked)', 'r2')} FROM rated",
    "accuracy_macro_micro": """SELECT round(avg(a), 6) AS macro, round(CAST(sum(ok) AS DOUBLE) / sum(n), 6) AS micro FROM
        (SELECT count_if(correct) AS ok, count_if(gt_valid) AS n, CAST(count_if(correct) AS DOUBLE) / count_if(gt_valid) AS a FROM cells GROUP BY name) q""",
    "confidence_by_correct": f"SELECT name, correct, row_number() OVER (PARTITION BY name, correct ORDER BY likelihood) - 1 AS place, {_r('likelihood', 'conf')} FROM cells JOIN gt USING (name, t)",
    "match_tracks": "SELECT g.name AS gt_name, p.name AS pred_name, count(*) AS n FROM gt g JOIN pred p USING (t, raw_seg_id) WHERE p.name = 1 + ((g.name - 1) * 3) % 10 GROUP BY ALL",
    "match_on_frames": """SELECT g.name AS gt_name, p.name AS pred_name, count(*) AS n FROM gt g JOIN pred p USING (t, raw_seg_id)
        WHERE t IN (1, 2, 4, 7, 8) AND p.name = 1 + ((g.name - 1) * 3) % 10 GROUP BY ALL""",
    "finished_only": "SELECT name, t, true AS finished FROM gt WHERE name % 2 = 0 UNION ALL SELECT name, t, false FROM gt",
    "rename_by": "SELECT g.gt_name AS name, p.t, p.raw_seg_id FROM pred p JOIN (SELECT DISTINCT name AS gt_name, 1 + ((name - 1) * 3) % 10 AS pred_name FROM gt) g ON g.pred_name = p.name WHERE gt_name > 2",
    "class_embeddings": """SELECT label, place, linear_ind, CAST(i - 1 AS INT) AS i, round(x[i], 6) + 0.0 AS v FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY linear_ind) - 1 AS place, linear_ind, x
        FROM noisy WHERE label <> -1) q, (SELECT unnest(range(1, 65)) AS i) r""",
    "pad_rows": """SELECT t, count(*) AS n FROM gt GROUP BY t UNION ALL SELECT CAST(unnest(range(last + 1, last + 1 + n_frames + 7 - n)) AS INT), NULL
        FROM (SELECT max(t) AS last, count(DISTINCT t) AS n, any_value(n_frames) AS n_frames FROM gt, n_frames) q""",
    "drop_last_frame": "SELECT name, t FROM gt, n_frames WHERE t < n_frames - 1",
    "valid_sample": "SELECT t FROM (SELECT t FROM gt GROUP BY t HAVING count(*) > 5 AND count(*) <= 200) q ORDER BY (t * 7919) % 1009, t LIMIT 7",
    "base_window": """SELECT CAST(start AS INT) AS start, count(DISTINCT name) AS n FROM (SELECT *, max(t + 1) OVER () AS last FROM gt) g JOIN (SELECT DISTINCT unnest(range(0, m - 4, 2) || [m - 5]) AS start
        FROM (SELECT max(t) + 1 AS m FROM gt) a) w ON t BETWEEN start AND start + 3 GROUP BY start ORDER BY n DESC, start LIMIT 1""",
    "tracked_names": "SELECT linear_ind, printf('neuron_%03d', name) AS obj_name FROM gt",
    "crop_voxels": f"""SELECT linear_ind, CAST(pos AS INT) AS pos, CAST(CASE WHEN az >= padz AND az - padz + z0 < z1 AND ax >= padx AND ax - padx + x0 < x1 AND ay >= pady AND ay - pady + y0 < y1
        THEN ((az - padz + z0) * 6 + ax - padx + x0) * 5 + ay - pady + y0 + t * 1000 + 1 ELSE 0 END AS DOUBLE) AS v FROM
        (SELECT *, pos // 12 AS az, (pos // 3) % 4 AS ax, pos % 3 AS ay FROM (SELECT linear_ind, t, {_bounds({'z': 'CAST(round_even(z / 4, 0) AS INT)', 'x': 'CAST(round_even(x / 20, 0) AS INT)', 'y': 'CAST(round_even(y / 25, 0) AS INT)'}, (4, 6, 5), (2, 4, 3))} FROM det) a,
        (SELECT unnest(range(24)) AS pos) b) c""",
    "names_by_segment": "SELECT linear_ind, name FROM det LEFT JOIN (SELECT t, raw_seg_id, max(name) AS name FROM pred GROUP BY ALL) p USING (t, raw_seg_id)",
    "raw_index": "SELECT linear_ind, CAST(CASE WHEN linear_ind % 3 = 0 THEN raw_neuron_ind + 100 WHEN linear_ind % 5 <> 0 THEN raw_neuron_ind END AS INT) AS raw_neuron_ind FROM det",
    "neither": "SELECT linear_ind FROM det ANTI JOIN kept USING (gt_label, linear_ind) WHERE gt_label % 2 <> 0",
    "without_noise": "SELECT linear_ind, label FROM noisy WHERE label <> -1",
    "thresholded": f"SELECT run, linear_ind, CASE WHEN prob < 0.75 THEN -1 ELSE label END AS label, {_r('CASE WHEN prob < 0.75 THEN 0 ELSE prob END', 'prob')} FROM labelings",
    "discover_anchored": "SELECT DISTINCT CAST(user_id AS INT) AS trial FROM events WHERE user_id % 2 = 1",
    "read_stats": f"SELECT CAST(trial AS INT) AS trial, pos, {_r('loss')} FROM stats",
    "config_merge": "SELECT trial, k, '0.1' AS lr, CAST(NULL AS VARCHAR) AS dim FROM cfg",
    "config_changes": """SELECT trial, 'k' AS name, k AS was, '7' AS becomes FROM cfg WHERE k IS DISTINCT FROM '7' UNION ALL
        SELECT trial, 'folder', folder, replace(folder, '/old/', '/new/') FROM cfg""",
    "read_yaml": "SELECT folder, k, '0.25' AS lr, CAST(NULL AS VARCHAR) AS nest, '3' AS nest_k, 'y' AS b, '2' AS size FROM cfg",
    "rewrite_yaml": """SELECT name, value, count(*) AS n FROM (SELECT 'folder' AS name, folder AS value FROM cfg UNION ALL SELECT 'k', k FROM cfg UNION ALL
        SELECT p.name, p.value FROM cfg, (SELECT unnest(['nest.k', 'nest.deep.a', 'nest.deep.b.0', 'nest.new', 'sizes.0', 'sizes.1', 'lr']) AS name, unnest(['3', '1', 'z', '1', '1', '2', '7']) AS value) p) q GROUP BY ALL""",
    "repeated_trials": "SELECT DISTINCT user_id AS trial, CAST(repetition AS INT) AS repetition FROM events, (SELECT unnest(range(3)) AS repetition) q",
    "trial_accuracy": f"""SELECT s.trial, CAST(k AS BIGINT) AS k, {_r('val_loss')}, n, accuracy FROM second_last s JOIN cfg USING (trial) LEFT JOIN (SELECT trial, count(*) AS n FROM stats GROUP BY trial) m USING (trial)
        LEFT JOIN (SELECT name, round(CAST(count_if(correct) AS DOUBLE) / nullif(count_if(gt_valid), 0), 6) AS accuracy FROM cells GROUP BY name) a ON name = s.trial""",
    "knn_lsh": "SELECT src % 5 AS block, count(*) AS wanted, true AS enough FROM near WHERE rk <= 5 AND dist <= 0.9 GROUP BY 1",
    "knn_descent": "SELECT src % 5 AS block, count(*) AS wanted, true AS enough FROM near GROUP BY 1",
    "fuzzy_graph": f"SELECT src, dst, {_r('max(w) + max(back) - max(w) * max(back)', 'w')} FROM (SELECT src, dst, w, 0.0::DOUBLE AS back FROM fuzz UNION ALL SELECT dst, src, 0.0, w FROM fuzz) q GROUP BY ALL",
    "seed_shares": "SELECT run, node, round(max(p) / sum(p), 6) AS p FROM h3 GROUP BY run, node",
    "labelings_of": """SELECT run, linear_ind, t, label, round(p, 6) AS prob FROM (SELECT *, e / sum(e) OVER (PARTITION BY run, node) AS p, row_number() OVER (PARTITION BY run, node ORDER BY e DESC, label) AS rn FROM
        (SELECT run, node, label, exp((p - max(p) OVER (PARTITION BY run, node)) / 0.02::DOUBLE) AS e FROM (SELECT run, node, label, round(p, 9) AS p FROM h3 UNION ALL SELECT DISTINCT run, node, 0, 0.0::DOUBLE FROM h3) a) b) c
        JOIN det ON det.linear_ind = node WHERE rn = 1 AND label > 0 AND p >= 0.11::DOUBLE""",
    "node_goodness": f"""SELECT node, total, kept, {_r('CAST(kept AS DOUBLE) / total', 'purity')}, {_r('0.1::DOUBLE * kept / total + 0.9::DOUBLE * kept / n_frames', 'goodness')} FROM
        (SELECT c.anc AS node, count(*) AS total, count(DISTINCT t) AS kept FROM closure c JOIN leaf l ON l.child = c.node JOIN det d ON d.linear_ind = l.point GROUP BY c.anc) q, n_frames WHERE total <= 2 * n_frames""",
    "fuse_labels_votes": "SELECT t, max(v) AS votes FROM s10 GROUP BY t",
    "align_all_votes": "SELECT t, max(v) AS votes FROM s10 GROUP BY t",
    "align_pair": f"SELECT run, linear_ind, t, CAST(1 + (label - 2 + 10) % 10 AS INT) AS label, {_r('prob')} FROM labelings WHERE run = 1",
    "feature_gram": f"SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, {_r('sum(x[i] * x[j])', 'g')} FROM vec, (SELECT unnest(range(1, 65)) AS i) a, (SELECT unnest(range(1, 65)) AS j) b GROUP BY i, j",
    "approximate_predict": f"""SELECT linear_ind, CASE WHEN inside THEN label ELSE -1 END AS label, {_r('CASE WHEN inside THEN least(density, top) / top ELSE 0 END', 'prob')} FROM
        (SELECT linear_ind, label, 1 / reach AS density, 2.0::DOUBLE + label / 10 AS top, label >= 0 AND 1 / reach >= 1.0::DOUBLE + label / 50 AS inside FROM
        (SELECT *, row_number() OVER (PARTITION BY linear_ind ORDER BY greatest(d, own, core), dst) AS best, greatest(d, own, core) AS reach FROM
        (SELECT *, max(CASE WHEN rk <= 3 THEN d END) OVER (PARTITION BY linear_ind) AS own FROM (SELECT a.linear_ind, b.linear_ind AS dst, b.label, core, {_euclid()} AS d,
        row_number() OVER (PARTITION BY a.linear_ind ORDER BY {_euclid()}, b.linear_ind) AS rk FROM noisy a, fit b JOIN fitcore c ON c.linear_ind = b.linear_ind
        WHERE a.t NOT IN (SELECT t FROM chosen)) p WHERE rk <= 6) q) r WHERE best = 1) s""",
    "catalog_tables": "SELECT linear_ind, t, CAST(len(x) AS BIGINT) AS n FROM vec",
    "nan_to_null": f"SELECT linear_ind, {_r('CASE WHEN linear_ind % 4 <> 0 THEN z END', 'z')} FROM det",
    "stream_labels": f"""SELECT CAST(label AS INT) AS name, t, raw_neuron_ind FROM (SELECT q.label, d.t, d.raw_neuron_ind, row_number() OVER (PARTITION BY q.label, d.t ORDER BY likelihood DESC, linear_ind) AS first FROM
        (SELECT a.linear_ind, b.label, row_number() OVER (PARTITION BY a.linear_ind ORDER BY {_euclid()}, b.linear_ind) rn
        FROM vec a, vec b WHERE a.t NOT IN (SELECT t FROM chosen) AND b.t IN (SELECT t FROM chosen)) q JOIN det d USING (linear_ind) WHERE rn = 1) r WHERE first = 1""",
    "displacement": f"""SELECT name, t, {_r(_distance('b', 'a'), 'dist')} FROM (SELECT n.name, s.t, g.z, g.x, g.y,
        lag(g.z) OVER w AS pz, lag(g.x) OVER w AS px, lag(g.y) OVER w AS py FROM (SELECT DISTINCT name FROM gt) n
        CROSS JOIN (SELECT CAST(unnest(range(n_frames)) AS INT) AS t FROM n_frames) s LEFT JOIN gt g ON g.name = n.name AND g.t = s.t
        WINDOW w AS (PARTITION BY n.name ORDER BY s.t)) q""".replace("(b.z - a.z)", "(z - pz)").replace("(b.x - a.x)", "(x - px)").replace("(b.y - a.y)", "(y - py)"),
    "carried_index": """SELECT n.name, s.t, g.raw_neuron_ind, last_value(g.raw_neuron_ind IGNORE NULLS) OVER
        (PARTITION BY n.name ORDER BY s.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ind FROM (SELECT DISTINCT name FROM gt) n
        CROSS JOIN (SELECT CAST(unnest(range(n_frames)) AS INT) AS t FROM n_frames) s LEFT JOIN gt g ON g.name = n.name AND g.t = s.t""",
    "noise_count": "SELECT CAST(count_if(linear_ind % 9 = 0) AS BIGINT) AS n FROM det",
    "nn_distance_all": f"SELECT a.linear_ind, a.t, {_r(f'min({_distance("a", "b")})', 'dist')} FROM det a JOIN det b ON a.t = b.t AND a.linear_ind <> b.linear_ind GROUP BY a.linear_ind, a.t",
    "nn_distance_mean": f"""SELECT t, {_r('avg(dist)', 'mean_dist')} FROM (SELECT DISTINCT t FROM det) s LEFT JOIN
        (SELECT a.linear_ind, a.t, min({_distance('a', 'b')}) AS dist FROM det a JOIN det b ON a.t = b.t AND a.linear_ind <> b.linear_ind GROUP BY ALL) q USING (t) GROUP BY t""",
    "adjacent_tracking_accuracy": f"""SELECT name, CAST(count_if(own = found) AS BIGINT) AS correct, count(*) AS total FROM (SELECT a.name, n.t, n.linear_ind AS own,
        first(b.linear_ind ORDER BY {_distance('a', 'b')}, b.linear_ind) AS found FROM gt a JOIN gt n ON n.name = a.name AND n.t = a.t + 1
        JOIN det b ON b.t = n.t GROUP BY a.name, n.t, n.linear_ind) q GROUP BY name""",
    "template_match": f"""SELECT linear_ind, template_ind, {_r('exp(-d) / z', 'conf')}, label = tlabel AS agree FROM (SELECT *, row_number() OVER (PARTITION BY linear_ind ORDER BY d, template_ind) AS rn,
        sum(exp(-d)) OVER (PARTITION BY linear_ind) AS z FROM (SELECT a.linear_ind, a.label, b.linear_ind AS template_ind, b.label AS tlabel, {_euclid()} AS d
        FROM vec a, vec b WHERE a.t > 0 AND b.t = 0) p) q WHERE rn = 1""",
    "common_neurons": "SELECT name FROM gt INTERSECT SELECT name FROM pred",
    "pad_frames": """SELECT n.name, s.t, p.raw_seg_id FROM (SELECT DISTINCT name FROM pred) n CROSS JOIN
        (SELECT CAST(unnest(range(n_frames)) AS INT) AS t FROM n_frames) s LEFT JOIN pred p ON p.name = n.name AND p.t = s.t""",
    "frame_size_filter": "SELECT t, count(*) AS n FROM gt GROUP BY t HAVING count(*) > 1 AND count(*) <= 200",
    "overlapping_windows": """SELECT start, t, count(*) AS n FROM det JOIN (SELECT DISTINCT CAST(start AS INT) AS start FROM n_frames,
        (SELECT unnest(range(0, n_frames - 20, 10) || [n_frames - 21]) AS start FROM n_frames) q) w ON t BETWEEN start AND start + 19 GROUP BY ALL""",
    "global_frames": "SELECT t FROM chosen",
    "nonglobal_frames": "SELECT DISTINCT t FROM det WHERE t NOT IN (SELECT t FROM chosen)",
    "linear_index": "SELECT linear_ind, row_number() OVER (ORDER BY gt_label, t, linear_ind) - 1 AS new_ind FROM det",
    "frames_by_size": "SELECT t, n, row_number() OVER (ORDER BY n DESC, t) AS rk FROM (SELECT t, count(*) AS n FROM gt GROUP BY t) q",
    "train_val_test_split": """SELECT t, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT t, row_number() OVER (ORDER BY (t * 7919) % 1009, t) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM det) a) b""",
    "crop_bounds": f"SELECT linear_ind, {_bounds({a: f'CAST(round_even({a}, 0) AS INT)' for a in 'zxy'})} FROM det",
    "crop_bounds_bbox": f"SELECT linear_ind, {_bounds({a: f'CAST(trunc((({a} - 1.3::DOUBLE) + ({a} + 1.3::DOUBLE)) / 2) AS INT)' for a in 'zxy'})} FROM det",
    "detection_names": "SELECT * FROM untracked",
    "parse_untracked_name": """SELECT obj_name, CAST(string_split(obj_name, '_')[-2] AS INT) AS raw_neuron_ind, CAST(string_split(obj_name, '_')[-1] AS INT) AS raw_seg_id
        FROM untracked WHERE starts_with(obj_name, 'untracked_')""",
    "pivot_frame": "SELECT t, " + ", ".join(f"round(max(CASE WHEN gt_label = {n} THEN z END), 6) AS n{n}" for n in range(1, 11)) + " FROM det WHERE t = 0 GROUP BY t",
    "rescale_intensity": """SELECT linear_ind, pos, round(CASE WHEN hi > lo THEN (greatest(v, lo) - lo) / (hi - lo) ELSE 0 END, 6) AS val FROM
        (SELECT t, linear_ind, CAST(i - 1 AS INT) AS pos, x[i] AS v FROM vec, (SELECT unnest(range(1, 65)) AS i) a) b JOIN
        (SELECT t, quantile_cont(v, 0.05) AS lo, max(v) AS hi FROM (SELECT t, unnest(x) AS v FROM vec) c GROUP BY t) d USING (t)""",
    "cluster_to_tracks": f"SELECT name, t, raw_neuron_ind, {_r('likelihood')} FROM gt",
    "cluster_to_tracks_last": """SELECT gt_label AS name, t, raw_neuron_ind FROM (SELECT *, row_number() OVER (PARTITION BY gt_label, t ORDER BY linear_ind DESC) rn FROM det) q WHERE rn = 1""",
    "cluster_to_tracks_first": """SELECT gt_label AS name, t, place AS raw_neuron_ind FROM (SELECT *, row_number() OVER (PARTITION BY gt_label, t ORDER BY linear_ind) rn,
        CAST(row_number() OVER (PARTITION BY t ORDER BY linear_ind) - 1 AS INT) AS place FROM det) q WHERE rn = 1""",
    "time_purity": "SELECT gt_label, count(DISTINCT t) AS kept, count(*) AS total, round(CAST(count(DISTINCT t) AS DOUBLE) / count(*), 6) AS purity FROM det GROUP BY gt_label",
    "time_purity_kept": "SELECT * FROM kept",
    "cluster_goodness": """SELECT gt_label, round(0.1::DOUBLE * CAST(count(DISTINCT t) AS DOUBLE) / count(*) + 0.9::DOUBLE * CAST(count(DISTINCT t) AS DOUBLE) / max(n_frames), 6) AS goodness
        FROM det, n_frames GROUP BY gt_label""",
    "greedy_top1": "SELECT run, t, label, linear_ind FROM top1",
    "unassigned_points": "SELECT linear_ind FROM det WHERE linear_ind NOT IN (SELECT linear_ind FROM kept)",
    "outlier_points": "SELECT gt_label, linear_ind FROM det ANTI JOIN kept USING (gt_label, linear_ind)",
    "seed_stats": """SELECT t, CAST(count_if(linear_ind % 5 = 0) AS BIGINT) AS n_assigned, CAST(count_if(linear_ind % 5 <> 0 AND gt_label > 1) AS BIGINT) AS n_cluster,
        CAST(count_if(linear_ind % 5 <> 0 AND gt_label <= 1) AS BIGINT) AS n_leaf FROM det GROUP BY t""",
    "stats_second_last": f"SELECT trial, {_r('val_loss')} FROM second_last",
    "discover_trials": r"SELECT DISTINCT CAST(regexp_extract('runs/trial_' || user_id || '/log', 'trial_(\d+)', 1) AS INT) AS trial FROM events",
    "training_finished": "SELECT trial, max(pos) = 69 AS finished FROM stats GROUP BY trial",
    "trial_project_join": "SELECT DISTINCT user_id AS trial, 'project_' || user_id AS project FROM events WHERE user_id % 2 = 0",
    "param_grid": "SELECT trial, CAST(lr AS DOUBLE) AS lr, CAST(dim AS INT) AS dim, CAST(z AS INT) AS z FROM (VALUES (0.1), (0.01)) a(lr), (VALUES (32), (64)) b(dim), (VALUES (4), (8)) c(z), (SELECT DISTINCT user_id AS trial FROM events) d",
    "one_at_a_time": "SELECT * FROM (VALUES ('lr', '0.1'), ('lr', '0.01'), ('dim', '32'), ('dim', '64'), ('z', '4'), ('z', '8')) v(param, value), (SELECT DISTINCT user_id AS trial FROM events) d",
    "loss_by_epoch": f"SELECT trial, CAST(pos // 10 AS INT) AS epoch, {_r('sum(loss)', 'loss')} FROM stats GROUP BY ALL",
    "best_trial": "SELECT trial, round(coalesce(val_loss, 1e6), 6) AS val_loss FROM second_last ORDER BY coalesce(val_loss, 1e6), trial LIMIT 1",
    "trial_summary": f"""SELECT s.trial, k, {_r('val_loss')}, n FROM second_last s LEFT JOIN (SELECT user_id AS trial, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k
        FROM events GROUP BY user_id) c USING (trial) LEFT JOIN (SELECT trial, count(*) AS n FROM stats GROUP BY trial) m USING (trial)""",
    "lr_schedule": """SELECT trial, pos, round(CASE WHEN i < 400 THEN i / 256.0::DOUBLE / 400 ELSE q / 256.0::DOUBLE + 0.001::DOUBLE / 256 * (1 - q) END, 9) AS lr
        FROM (SELECT trial, pos, pos * 20 AS i, 0.5::DOUBLE * (1 + cos(pi() * (pos * 20 - 400) / 1600)) AS q FROM stats) a""",
    "split_model_name": """SELECT model, parts[len(parts)] AS lab, array_to_string(parts[:len(parts) - 1], '_') AS prefix FROM (SELECT model, string_split(model, '_') AS parts FROM
        (SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN concat_ws('_', 'net', user_id, event_type) ELSE concat_ws('_', 'a', 'b', user_id, 'lab') END AS model FROM events) a WHERE model IS NOT NULL) b""",
    "knn_graph": "SELECT src, dst, CAST(rk AS INT) AS rk FROM near",
    "seed_labels": "SELECT run, node, label FROM seeds",
    "label_prop_step": f"SELECT run, node, label, {_r('p')} FROM h1",
    "label_prop_3": f"SELECT run, node, label, {_r('p')} FROM h3",
    "label_topk": """SELECT run, node, label, round(p, 6) AS p, CAST(rk AS INT) AS rk FROM (SELECT run, node, label, p, row_number() OVER (PARTITION BY run, node ORDER BY p DESC, label) AS rk
        FROM (SELECT run, node, label, round(p, 9) AS p FROM h3) a) q WHERE rk <= 2""",
    "label_softmax": """SELECT run, node, label, round(e / sum(e) OVER (PARTITION BY run, node), 6) AS p FROM
        (SELECT run, node, label, exp((p - max(p) OVER (PARTITION BY run, node)) / 0.02::DOUBLE) AS e FROM h3) q""",
    "label_rownorm": "SELECT run, node, label, round(p / sum(p) OVER (PARTITION BY run, node), 6) AS p FROM h3",
    "tree_closure": "SELECT anc, node FROM closure",
    "tree_ancestors": "SELECT node, count(*) AS n_anc FROM closure WHERE node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL) GROUP BY node",
    "bucketed_votes": "SELECT t, linear_ind, label, count(*) AS n FROM votes GROUP BY ALL",
    "vote_counts": "SELECT t, linear_ind, label, count(*) AS n FROM votes GROUP BY ALL",
    "label_confusion": "SELECT ref, new, n FROM confusion",
    "column_weights": "SELECT run, label, round(1 / sqrt(sum(prob) + 1e-8), 6) AS w FROM top1 GROUP BY ALL",
    "row_normalize": f"SELECT run, linear_ind, label, {_r('val')} FROM unit",
    "consensus_votes": f"SELECT linear_ind, CAST(1 + (label - 1 - run + 10) % 10 AS INT) AS label, {_r('sum(prob)', 'votes')} FROM top1 GROUP BY ALL",
    "label_coverage_diag": """SELECT min(n) AS min_n, max(n) AS max_n, round(avg(n), 6) AS mean_n FROM
        (SELECT d.linear_ind, count(DISTINCT run) AS n FROM det d LEFT JOIN labelings l USING (linear_ind) GROUP BY d.linear_ind) q""",
    "unmatched_labels": "SELECT DISTINCT label FROM labelings WHERE run = 1 AND label NOT IN (SELECT new FROM confusion WHERE ref <= 5 AND n > 3)",
    "gram_matrix": f"""SELECT a.run AS run1, a.label AS label1, b.run AS run2, b.label AS label2, {_r('sum(a.val * b.val)', 'g')}
        FROM unit a JOIN unit b USING (linear_ind) GROUP BY ALL""",
    "cross_corr_features": f"SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, {_r('c')} FROM feat",
    "cross_corr_objects": f"SELECT t, i, j, {_r('c')} FROM objs",
    "barlow_loss": """SELECT round(f, 6) AS loss_feat, round(o, 6) AS loss_obj, round((1 - 0.67::DOUBLE) * f + 0.67::DOUBLE * o, 6) AS loss FROM
        (SELECT sum(CASE WHEN i = j THEN (c - 1) * (c - 1) ELSE 0.0051::DOUBLE * c * c END) / count(*) AS f FROM feat) a,
        (SELECT sum(CASE WHEN i = j THEN (c - 1) * (c - 1) ELSE 0.0051::DOUBLE * c * c END) / count(*) AS o FROM objs) b""",
    "core_distance": f"SELECT linear_ind, {_r('core')} FROM core5",
    "mutual_reachability": f"""SELECT src, dst, {_r('greatest(q.core, core5.core, dist)', 'mr')} FROM
        (SELECT src, dst, dist, max(dist) OVER (PARTITION BY src) AS core FROM near WHERE rk <= 5) q JOIN core5 ON core5.linear_ind = dst WHERE src <> dst""",
    "spanning_weights": f"SELECT round(e.w, 6) + 0.0 AS w, count(*) AS n FROM (SELECT e FROM ({' UNION ALL '.join(f'SELECT e FROM e{i}' for i in range(1, 11))}) u GROUP BY e) q GROUP BY 1",
    "nn_label_assign": """SELECT linear_ind, CAST(label AS INT) AS label FROM (SELECT a.linear_ind, b.label,
        row_number() OVER (PARTITION BY a.linear_ind ORDER BY sqrt(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (b.x[i] - a.x[i]) * (b.x[i] - a.x[i])))), b.linear_ind) rn
        FROM vec a, vec b WHERE a.t NOT IN (SELECT t FROM chosen) AND b.t IN (SELECT t FROM chosen)) q WHERE rn = 1""",
    "cluster_counts": "SELECT t, count(DISTINCT gt_label) AS n FROM det GROUP BY t",
    "cluster_centroids": f"SELECT CAST(label AS INT) AS label, CAST(i - 1 AS INT) AS i, {_r('avg(x[i])', 'mean')} FROM vec, (SELECT unnest(range(1, 65)) AS i) r GROUP BY label, i",
    "svd_products": f"SELECT a.linear_ind AS i, b.linear_ind AS j, {_r('list_dot_product(a.x, b.x)', 'p')} FROM vec a JOIN vec b ON a.t = b.t AND a.linear_ind <= b.linear_ind",
}


def _needed(text: str, have: list[str]) -> list[str]:
    """The views that text names, after those that they name."""
    for name in VIEWS:
        if name not in have and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
            have = [*_needed(VIEWS[name], have), name] if name not in have else have
    return have


BODIES["stream_predict"] = BODIES["approximate_predict"]  # the same rows, by way of a stream


def statements() -> dict[str, str]:
    out = {}
    for name, body in BODIES.items():
        views = list(dict.fromkeys(_needed(body, [])))
        out[name] = ("WITH " + ", ".join(f"{v} AS {'MATERIALIZED ' * (v in WRITTEN)}({VIEWS[v]})" for v in views) + " " if views else "") + body
    return out
