"""DuckDB SQL for the registered queries, written independently of the Spark plans."""

from __future__ import annotations

from ..operators.reports import FIRST_COLUMNS

ORACLES: dict[str, str] = {}
MODES = ("conservative", "balanced", "aggressive")


def d(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def r(x: str, digits: int = 4) -> str:
    return f"(floor(({x}) * {d(10**digits)} + {d(0.5)}) / {d(10**digits)})"


def clamp(x: str) -> str:
    return f"greatest({d(0)}, least({d(1)}, {x}))"


# --- tiles ---------------------------------------------------------------

TILES = f"""tiles AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(greatest(0, least(255, floor({d(128)} + (label - 4) * 24 + v::DOUBLE * (20 + 8 * label)))) AS BIGINT)) AS px
  FROM embeddings WHERE len(embedding) = 64)"""


def _p(row: str, col: str) -> str:
    return f"px[(({row}) // 4) * 8 + ({col}) // 4 + 1]"


def _regions(boxes: list[tuple[int, int, int, int]], name: str = "regions") -> str:
    """Per tile and box: moments of Laplacian, squared gradient and pixel count."""
    values = ", ".join(str((i, *b)) for i, b in enumerate(boxes))
    up, down = "y + abs(i - 1) % greatest(h, 1)", "y + (h - 1) - abs((h - 1) - (i + 1))"
    left, right = "x + abs(j - 1) % greatest(w, 1)", "x + (w - 1) - abs((w - 1) - (j + 1))"
    here_r, here_c = "y + i", "x + j"
    lap = f"{_p(up, here_c)} + {_p(down, here_c)} + {_p(here_r, left)} + {_p(here_r, right)} - 4 * {_p(here_r, here_c)}"
    gx = " + ".join(f"{k} * ({_p(row, right)} - {_p(row, left)})" for k, row in ((1, up), (2, here_r), (1, down)))
    gy = " + ".join(f"{k} * ({_p(down, col)} - {_p(up, col)})" for k, col in ((1, left), (2, here_c), (1, right)))
    return f"""{name}_cells AS (SELECT vec_id, label, box, {lap} AS lap, {gx} AS gx, {gy} AS gy, {_p(here_r, here_c)} AS p
  FROM tiles, (VALUES {values}) b(box, x, y, w, h), range(32) ri(i), range(32) rj(j) WHERE i < h AND j < w),
{name} AS (SELECT vec_id, label, box, count(*) AS n, sum(lap)::BIGINT AS s1, sum(lap * lap)::BIGINT AS s2, sum(gx * gx + gy * gy)::BIGINT AS g2, sum(p)::BIGINT AS p1, sum(p * p)::BIGINT AS p2,
  count(*) FILTER (p >= 245) AS bright, count(*) FILTER (p <= 10) AS dark FROM {name}_cells GROUP BY ALL)"""


_VAR = f"((n * s2 - s1 * s1) / (n * n)::DOUBLE)"
TECHNICAL = f"""{TILES}, {_regions([(0, 0, 32, 32)], "whole")},
raw AS (SELECT vec_id, label, {_VAR} AS laplacian, p1 / n::DOUBLE AS brightness, g2 / n::DOUBLE AS gradient, sqrt((n * p2 - p1 * p1) / (n * n)::DOUBLE) AS spread, bright / n::DOUBLE + dark / n::DOUBLE AS clipped FROM whole),
technical AS (SELECT vec_id, label, laplacian, brightness, gradient, {r(clamp(f"laplacian / {d(300)}"))} AS sharpness,
  {r(clamp(f"{d(1)} - least(abs(brightness - {d(128)}) / {d(128)}, {d(1)}) - {d(0.5)} * clipped"))} AS exposure, {r(clamp(f"spread / {d(80)}"))} AS contrast,
  {r(clamp(f"{d(1)} - {clamp(f'laplacian / {d(300)}')}"))} AS global_blur_penalty FROM raw)"""
CENTRAL = [(6, 10, 19, 18), (8, 12, 14, 15), (3, 14, 24, 12)]
BODY = f"""{_regions(CENTRAL, "central")},
sharp AS (SELECT vec_id, {r(clamp(f"{d(0.65)} * {clamp(f'{_VAR} / {d(220)}')} + {d(0.35)} * {clamp(f'(g2 / n::DOUBLE) / {d(9000)}')}"))} AS s FROM central),
best AS (SELECT vec_id, {r(clamp(f"{d(0.7)} * max(s) + {d(0.3)} * median(s)"))} AS body_sharpness FROM sharp GROUP BY vec_id),
body0 AS (SELECT vec_id, body_sharpness, {r(f"{d(1)} - body_sharpness")} AS body_blur_penalty FROM best),
body AS (SELECT vec_id, true AS person_detected, body_sharpness, body_blur_penalty, {r(clamp(f"{d(0.85)} * body_sharpness + {d(0.15)} * ({d(1)} - body_blur_penalty)"))} AS subject_score FROM body0)"""


def final(mode: str) -> str:
    weight = 0.30 if mode in ("balanced", "aggressive") else 0.25
    gw, pw = {"conservative": (0.10, 0.14), "aggressive": (0.22, 0.28)}.get(mode, (0.15, 0.20))
    part = f"CASE WHEN subject_score = 0 AND (body_sharpness <> 0 OR body_blur_penalty <> 0) THEN {clamp(f'body_sharpness - {d(0.35)} * body_blur_penalty')} ELSE subject_score END"
    return r(clamp(f"{d(0.30)} * sharpness + {d(0.20)} * exposure + {d(0.10)} * contrast + {d(0.3)} * face_score + {d(weight)} * {part} - {d(gw)} * global_blur_penalty - {d(pw)} * body_blur_penalty".replace(part, f"({part})")))


ORACLES["tile_technical"] = f"WITH {TECHNICAL} SELECT vec_id, label, laplacian, brightness, sharpness, exposure, contrast, global_blur_penalty FROM technical"
ORACLES["tile_gradient"] = f"WITH {TECHNICAL} SELECT vec_id, gradient FROM technical"
ORACLES["stream_scores"] = f"WITH {TECHNICAL} SELECT vec_id, sharpness, exposure, contrast FROM technical"
ORACLES["tile_body"] = f"WITH {TILES}, {BODY} SELECT vec_id, person_detected, body_sharpness, body_blur_penalty, subject_score FROM body"
ORACLES["tile_faces"] = f"""WITH {TILES}, {_regions([(8, 6, 10, 10), (18, 4, 8, 8)], "face")}, f AS (SELECT vec_id, max({clamp(f"{_VAR} / {d(220)}")}) AS s FROM face GROUP BY vec_id)
SELECT vec_id, true AS face_detected, 2 AS face_count, {r("s")} AS face_sharpness, {r(clamp(f"{d(0.75)} * s + {d(0.06)} * 2"))} AS face_score FROM f"""
_GRID = [(c * 32 // 3, q * 32 // 3, (c + 1) * 32 // 3 - c * 32 // 3, (q + 1) * 32 // 3 - q * 32 // 3) for q in range(3) for c in range(3)]
ORACLES["local_patch_blur"] = f"""WITH {TILES}, {_regions(_GRID, "cell")} SELECT vec_id, count(*) FILTER ({_VAR} < 75) / 9::DOUBLE AS blurred_share, count(*) FILTER ({_VAR} < 75) / 9::DOUBLE >= 0.25 AS localized_blur FROM cell GROUP BY vec_id"""
ORACLES["exposure_classes"] = f"""WITH {TECHNICAL} SELECT label, CASE WHEN brightness < 50 THEN 'UNDEREXPOSED' WHEN brightness > 210 THEN 'OVEREXPOSED' ELSE 'NORMAL' END AS exposure_class, laplacian < 100 AS blurred, count(*) AS n FROM technical GROUP BY ALL"""


def _tile_scores(mode: str) -> str:
    return f"""WITH {TECHNICAL}, {BODY}, scored AS (SELECT t.vec_id, t.label, {final(mode)} AS final_score, subject_score, body_blur_penalty, face_score, sharpness
  FROM (SELECT *, {d(0.45)} AS face_score FROM technical) t JOIN body USING (vec_id))"""


for _m in MODES:
    ORACLES[f"final_score_{_m}"] = f"{_tile_scores(_m)} SELECT vec_id, final_score FROM scored"


def _statuses(mode: str, gap: str = "score_gap") -> str:
    sel, rev, close = {"conservative": (0.55, 0.35, 0.12), "balanced": (0.65, 0.45, 0.08), "aggressive": (0.75, 0.55, 0.03)}[mode]
    by_score = f"CASE WHEN final_score >= {d(rev)} THEN 'review' ELSE 'rejected' END"
    loser = {"aggressive": "'rejected'", "conservative": f"CASE WHEN rank <= 3 AND {gap} <= {d(close)} THEN 'review' ELSE {by_score} END", "balanced": f"CASE WHEN {gap} <= {d(close)} THEN 'review' ELSE {by_score} END"}[mode]
    return f"CASE WHEN rank = 1 THEN CASE WHEN final_score >= {d(sel)} THEN 'selected' ELSE {by_score} END ELSE {loser} END"


ORACLES["tile_pick_status"] = f"""{_tile_scores("balanced")}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY final_score DESC, subject_score DESC, 1 - body_blur_penalty DESC, face_score DESC, sharpness DESC, lower(vec_id::VARCHAR || '.jpg'), vec_id) AS rank FROM scored),
gapped AS (SELECT *, max(CASE WHEN rank = 1 THEN final_score END) OVER (PARTITION BY label) - final_score AS score_gap FROM ranked)
SELECT label::VARCHAR AS cluster_id, {_statuses("balanced")} AS status, count(*) AS n FROM gapped GROUP BY ALL"""

# --- order lines as items -------------------------------------------------

ITEMS0 = f"""items0 AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * {d(100)} + {d(0.5)})::BIGINT, strftime(l_shipdate, '%Y%m%d')) AS photo_id,
  '/photos/' || l_orderkey || '/IMG_' || l_partkey || '.jpg' AS path, 'IMG_' || l_partkey || '.jpg' AS file_name, 'O' || l_orderkey AS cluster_id,
  {r(f"l_quantity / {d(50)}")} AS sharpness, {r(f"l_discount * {d(10)}")} AS exposure, {r(f"l_tax * {d(12.5)}")} AS contrast, {r(f"{d(1)} - l_quantity / {d(50)}")} AS global_blur_penalty,
  l_linenumber % 2 = 0 AS face_detected, CASE WHEN l_linenumber % 2 = 0 THEN 1 + l_partkey % 4 ELSE 0 END AS face_count,
  CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey % 100) / {d(100)} ELSE {d(0)} END AS face_sharpness, CASE WHEN l_linenumber % 2 = 0 THEN (l_suppkey % 100) / {d(100)} ELSE {d(0.45)} END AS face_score,
  (floor(l_extendedprice)::BIGINT % 100) / {d(100)} AS body_sharpness, {r(f"{d(1)} - (floor(l_extendedprice)::BIGINT % 100) / {d(100)}")} AS body_blur_penalty,
  (floor(l_extendedprice)::BIGINT % 100) / {d(100)} AS subject_score FROM lineitem)"""


def items(score_mode: str = "balanced") -> str:
    """Ranked items with their cluster's winner."""
    winner = lambda c: f"first_value({c}) OVER w AS win_{c}"
    return f"""WITH {ITEMS0}, items AS (SELECT *, {final(score_mode)} AS final_score FROM items0),
ranked AS (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY cluster_id) AS cluster_size, {", ".join(winner(c) for c in ("photo_id", "file_name", "final_score", "body_blur_penalty", "face_score"))}
  FROM items WINDOW w AS (PARTITION BY cluster_id ORDER BY final_score DESC, subject_score DESC, 1 - body_blur_penalty DESC, face_score DESC, sharpness DESC, lower(file_name), photo_id)),
gapped AS (SELECT *, win_final_score - final_score AS score_gap FROM ranked)"""


def picked(mode: str = "balanced", score_mode: str | None = None) -> str:
    return f"{items(score_mode or mode)}, picked AS (SELECT *, {_statuses(mode)} AS status, CASE WHEN rank = 1 THEN {d(0)} ELSE {clamp('score_gap')} END AS duplicate_penalty FROM gapped)"


def two(x: str) -> str:
    h = f"(floor(({x}) * {d(100)} + {d(0.5)})::BIGINT)"
    return f"({h} // 100 || '.' || lpad(({h} % 100)::VARCHAR, 2, '0'))"


def reason_sql(mode: str) -> str:
    gap = f"greatest({d(0)}, score_gap)"
    follower = "(cluster_size > 1 AND rank > 1)"
    lines = [
        f"CASE WHEN cluster_size <= 1 THEN 'Unique image; decision is based on its own technical, face, and body scores.' WHEN rank = 1 THEN 'Selected as best image in similar cluster.' ELSE 'Similar to ' || win_file_name || '; final score lower by ' || {two(gap)} || '.' END",
        f"CASE WHEN {follower} AND body_blur_penalty - win_body_blur_penalty >= {d(0.08)} THEN 'Body blur penalty higher than winner by ' || {two('body_blur_penalty - win_body_blur_penalty')} || '.' END",
        f"CASE WHEN {follower} AND win_face_score - face_score >= {d(0.08)} THEN 'Face score lower than winner by ' || {two('win_face_score - face_score')} || '.' END",
        f"CASE WHEN {follower} AND {gap} <= {d(0.08)} AND status = 'review' THEN 'Close candidate kept for manual review.' WHEN {follower} AND {gap} > {d(0.15)} THEN 'Large score gap from selected winner.' END",
    ]
    if mode == "aggressive":
        lines.append("CASE WHEN status = 'rejected' AND rank > 1 THEN 'Aggressive mode rejects duplicate alternatives unless they clearly win.' END")
    if mode == "conservative":
        lines.append("CASE WHEN status = 'review' AND rank > 1 THEN 'Conservative mode keeps close duplicate candidates for review.' END")
    lines += [
        f"CASE WHEN NOT face_detected THEN 'No face detected.' WHEN face_sharpness >= {d(0.55)} THEN 'Good face sharpness.' WHEN face_sharpness > 0 THEN 'Face detected but face sharpness is weak.' ELSE 'Face detected.' END",
        f"CASE WHEN body_blur_penalty >= {d(0.45)} THEN 'Body/subject blur detected.' WHEN subject_score >= {d(0.65)} THEN 'Body/subject region is sharp.' END",
        f"CASE WHEN global_blur_penalty >= {d(0.55)} THEN 'Low global sharpness.' WHEN sharpness >= {d(0.65)} THEN 'Good global sharpness.' END",
        f"CASE WHEN exposure >= {d(0.65)} THEN 'Good exposure.' WHEN exposure < {d(0.30)} THEN 'Poor exposure.' END",
    ]
    return f"concat_ws('; ', {', '.join(lines)})"


for _m in MODES:
    ORACLES[f"pick_{_m}"] = f"{picked(_m)} SELECT photo_id, cluster_id, rank, cluster_size, win_photo_id AS winner_id, score_gap, duplicate_penalty, status FROM picked"
    _keep = {"conservative": f"rank IN (2, 3) AND score_gap <= {d(0.08)}", "balanced": f"rank = 2 AND cluster_size >= 4 AND score_gap <= {d(0.08)}", "aggressive": "false"}[_m]
    ORACLES[f"pick_simple_{_m}"] = f"{items()} SELECT photo_id, rank, CASE WHEN rank = 1 OR ({_keep}) THEN 'selected' ELSE 'rejected' END AS status FROM gapped"
    ORACLES[f"reasons_{_m}"] = f"{picked(_m)} SELECT photo_id, status, {reason_sql(_m)} AS reasons FROM picked"

_TECH = r(clamp(f"{d(0.5)} * sharpness + {d(0.3)} * exposure + {d(0.2)} * contrast"))
_PEN = f"CASE WHEN sharpness >= {d(0.45)} THEN {d(0)} ELSE {clamp(f'({d(0.45)} - sharpness) / {d(0.45)}')} END"
_TECHP = r(clamp(f"{d(0.5)} * sharpness + {d(0.3)} * exposure + {d(0.2)} * contrast - ({_PEN})"))
ORACLES["legacy_scores"] = f"""{items()}, a AS (SELECT *, CASE WHEN face_detected THEN body_sharpness * {d(180)} END AS raw_body, sharpness * {d(300)} AS raw_global, body_blur_penalty >= {d(0.45)} AS local,
  CASE WHEN exposure * {d(255)} < 50 THEN 'UNDEREXPOSED' WHEN exposure * {d(255)} > 210 THEN 'OVEREXPOSED' ELSE 'NORMAL' END AS kind,
  CASE WHEN face_count > 0 THEN least({d(1)}, {d(0.35)} + {d(0.25)} * face_count) ELSE {d(0.45)} END AS counted_face, {_TECHP} AS technical, contrast > 0.5 AS dup, face_count > 2 AS best FROM gapped),
b AS (SELECT *, CASE WHEN raw_body IS NULL THEN {d(0.45)} ELSE {clamp(f"raw_body / {d(180)}")} END AS body, CASE WHEN contrast > 0.2 THEN raw_body END AS raw_avg FROM a),
c AS (SELECT *, CASE WHEN local THEN {d(0.35)} ELSE greatest({d(0)}, {d(0.45)} - body) END AS penalty,
  100 + CASE WHEN raw_global < 100 THEN -40 ELSE 0 END + CASE WHEN kind <> 'NORMAL' THEN -25 ELSE 0 END + CASE WHEN face_detected THEN 15 ELSE -10 END + CASE WHEN dup AND NOT best THEN -30 ELSE 0 END + CASE WHEN dup AND best THEN 10 ELSE 0 END AS points FROM b)
SELECT photo_id, technical, {_TECH} AS blended, counted_face, body, penalty,
  {r(clamp(f"{d(0.3)} * technical + {d(0.3)} * (CASE WHEN face_detected THEN counted_face ELSE {d(0.45)} END) + {d(0.25)} * body + (CASE WHEN penalty > 0.35 THEN {d(0.03)} ELSE {d(0.1)} END) * {d(0.5)} - {d(0.2)} * penalty"))} AS weighted,
  points::INTEGER AS points, CASE WHEN points >= 80 THEN 'SELECTED' WHEN points >= 50 THEN 'REVIEW' ELSE 'REJECTED' END AS point_status,
  greatest(0, least(150, 100 + CASE WHEN face_detected THEN 20 ELSE -15 END + CASE WHEN raw_global >= 180 THEN 10 WHEN raw_global >= 100 THEN 0 WHEN raw_global >= 50 THEN -25 ELSE -60 END
    + CASE WHEN raw_body IS NULL THEN -10 WHEN raw_body >= 150 THEN 25 WHEN raw_body >= 100 THEN 10 WHEN raw_body >= 60 THEN -25 ELSE -50 END
    + CASE WHEN raw_avg IS NULL THEN 0 WHEN raw_avg >= 130 THEN 10 WHEN raw_avg >= 80 THEN 0 ELSE -20 END + CASE WHEN local THEN -35 ELSE 0 END + CASE WHEN kind <> 'NORMAL' THEN -15 ELSE 0 END))::INTEGER AS human,
  concat_ws('; ', CASE WHEN raw_global < 100 THEN 'blur' ELSE 'sharp' END, CASE kind WHEN 'NORMAL' THEN 'normal_exposure' ELSE lower(kind) END, CASE WHEN face_detected THEN 'has_face' ELSE 'no_face' END,
    CASE WHEN dup THEN CASE WHEN best THEN 'best_duplicate' ELSE 'duplicate_candidate' END END) AS notes FROM c"""
ORACLES["cluster_summary"] = f"""{picked()} SELECT cluster_id, max(CASE WHEN rank = 1 THEN photo_id END) AS winner_id, count(*) AS members, max(final_score) AS best_score, {r(f"max(greatest({d(0)}, score_gap))", 2)} AS largest_gap,
  count(*) FILTER (status = 'rejected') AS rejected FROM picked GROUP BY cluster_id"""
ORACLES["run_summary"] = f"""{picked()} SELECT count(*) AS total_processed, count(*) FILTER (status = 'selected') AS selected, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'rejected') AS rejected, 0::BIGINT AS errors,
  count(*) FILTER (global_blur_penalty > 0.55) AS blur_photos, 0::BIGINT AS underexposed_photos, 0::BIGINT AS overexposed_photos, count(DISTINCT cluster_id) AS duplicate_groups, count(*) FILTER (body_blur_penalty >= 0.45) AS localized_person_blur_photos,
  {r(f"sum(floor({r(f'final_score * {d(100)}', 2)} * {d(100)} + {d(0.5)})::BIGINT)::DOUBLE / {d(100)} / count(*)", 2)} AS average_final_score FROM picked"""
ORACLES["engine_summary"] = f"""{picked()} SELECT count(*) AS total_photos, count(*) FILTER (status = 'selected') AS selected_count, count(*) FILTER (status = 'review') AS review_count, count(*) FILTER (status = 'rejected') AS rejected_count,
  count(DISTINCT cluster_id) AS cluster_count, {r(f"sum(floor(final_score * {d(10000)} + {d(0.5)})::BIGINT)::DOUBLE / {d(10000)} / count(*)")} AS average_final_score FROM picked"""
_PCT = f"(CASE WHEN final_score <= 1 THEN final_score * {d(100)} ELSE final_score END)"
_TENTHS = f"(floor({_PCT} * {d(10)} + {d(0.5)})::BIGINT)"
ORACLES["status_warnings"] = f"""{picked()} SELECT photo_id, concat_ws('; ', CASE WHEN body_blur_penalty >= 0.45 THEN 'Body blur penalty tinggi' END, CASE WHEN face_score <> 0 AND face_score < 0.35 THEN 'Face score rendah' END, CASE WHEN {_PCT} < 50 THEN 'Final score rendah' END) AS warnings,
  ({_TENTHS} // 10) || '.' || ({_TENTHS} % 10) || '%' AS label FROM picked WHERE status <> 'selected'"""
def _nulls(*names: str) -> str:
    return ", ".join(f"NULL::VARCHAR AS {n}" for n in names)


ORACLES["report_rows"] = f"""{picked()} SELECT file_name AS filename, path, status, cluster_id, rank = 1 AS is_cluster_winner, win_photo_id AS selected_photo_id, final_score, {r(f"final_score * {d(100)}", 2)} AS score_percent,
  sharpness AS technical_sharpness, exposure AS technical_exposure, contrast AS technical_contrast, global_blur_penalty, face_detected, face_count, face_sharpness, face_score, true AS person_detected, body_sharpness, body_blur_penalty, subject_score,
  duplicate_penalty, 'balanced' AS mode, 'balanced' AS performance_mode, 1600 AS analysis_size, {reason_sql("balanced")} AS reasons,
  {_nulls("max_analysis_size", "worker_count", "used_cache", "cache_hit", "cache_key", "face_analysis_enabled", "body_blur_analysis_enabled", "similarity_grouping_enabled", "copy_files_after_culling")} FROM picked"""
ORACLES["flat_report_rows"] = f"""{picked()} SELECT file_name AS filename, path AS original_path, upper(status) AS output_status, {r(f"sharpness * {d(300)}", 2)} AS blur_score, global_blur_penalty > 0.55 AS is_blur,
  CASE WHEN exposure >= 0.5 THEN 'NORMAL' ELSE 'UNDEREXPOSED_OR_OVEREXPOSED' END AS exposure_status, face_count, face_detected AS has_face, cluster_id AS duplicate_group_id, cluster_size > 1 AS is_duplicate_candidate,
  rank = 1 AS best_in_duplicate_group, rank = 1 AS is_best_duplicate, {r(f"final_score * {d(100)}", 2)} AS final_score, {r(f"final_score * {d(100)}", 2)} AS score_percent, {reason_sql("balanced")} AS notes, {reason_sql("balanced")} AS final_reason, 1 AS person_count,
  {r(f"body_sharpness * {d(180)}", 2)} AS main_person_blur_score, body_blur_penalty >= 0.45 AS localized_person_blur, floor(final_score * {d(150)})::INTEGER AS human_quality_score, {r(f"{d(0.5)} * sharpness + {d(0.3)} * exposure + {d(0.2)} * contrast")} AS technical_score,
  sharpness AS sharpness_score, exposure AS exposure_score, contrast AS contrast_score, global_blur_penalty AS blur_penalty, face_score, face_sharpness AS face_sharpness_score, body_sharpness AS body_sharpness_score, body_blur_penalty, subject_score,
  {d(0.5)} AS aesthetic_score, 'balanced' AS culling_mode, win_photo_id AS selected_photo_id, true AS subject_detected, win_file_name AS cluster_winner_filename, {r(f"greatest({d(0)}, score_gap)")} AS score_gap_from_winner,
  {_nulls("output_path", "brightness_score", "error", "avg_person_blur_score", "min_person_blur_score", "duplicate_quality_rank", "thumbnail_path")} FROM picked"""
ORACLES["status_split"] = f"{picked()} SELECT photo_id, 'kept' AS side FROM picked WHERE status = 'selected' UNION ALL SELECT photo_id, 'dropped' FROM picked WHERE status = 'rejected'"

# --- hashes ----------------------------------------------------------------

ORACLES["hamming_pairs"] = """WITH s AS (SELECT vec_id AS id, embedding e, list_sort(embedding) o FROM embeddings WHERE len(embedding) = 64),
b AS (SELECT id, list_transform(e, lambda v: v::DOUBLE > (o[32] + o[33])::FLOAT::DOUBLE / 2) bits FROM s)
SELECT x.id AS a, y.id AS b, list_sum(list_transform(list_zip(x.bits, y.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INTEGER AS distance FROM b x JOIN b y ON x.id < y.id WHERE distance <= 18"""
_HASHES = """w AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+')) AS word FROM documents) WHERE word <> ''),
m AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 15))::BIGINT AS v FROM w),
k AS (SELECT doc_id, i, sum(CASE WHEN (v >> i) & 1 = 1 THEN 1 ELSE -1 END) AS votes FROM m, range(60) t(i) GROUP BY ALL),
h AS (SELECT doc_id AS id, sum(CASE WHEN votes > 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS hash FROM k GROUP BY doc_id)"""
ORACLES["exact_duplicates"] = f"WITH {_HASHES} SELECT min(id) AS first_id, count(*) AS copies FROM h GROUP BY hash HAVING count(*) > 1"
ORACLES["similarity_clusters"] = f"""WITH RECURSIVE {_HASHES}, e AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM h x JOIN h y ON x.id <> y.id AND bit_count(xor(x.hash, y.hash)) <= 8),
walk(id, reached) AS (SELECT id, id FROM h UNION SELECT walk.id, e.b FROM walk JOIN e ON walk.reached = e.a), comp AS (SELECT id, min(reached) AS component FROM walk GROUP BY id),
allc AS (SELECT doc_id AS id, coalesce(component, doc_id) AS component FROM documents LEFT JOIN comp ON doc_id = id), c AS (SELECT component, min(id) AS first_id, count(*) AS cluster_size FROM allc GROUP BY component),
n AS (SELECT *, row_number() OVER (ORDER BY first_id, component) AS no FROM c)
SELECT id, component, 'CL' || lpad(no::VARCHAR, greatest(4, length(no::VARCHAR))::INTEGER, '0') AS cluster_id, cluster_size, CASE WHEN cluster_size > 1 THEN 1::DOUBLE ELSE 0::DOUBLE END AS confidence,
  CASE WHEN cluster_size > 1 THEN 'CL' || lpad(no::VARCHAR, greatest(4, length(no::VARCHAR))::INTEGER, '0') END AS duplicate_group FROM allc JOIN n USING (component)"""

# --- boxes -------------------------------------------------------------------

_AT = lambda i: f"floor({d(100)} + embedding[{i + 1}]::DOUBLE * {d(150)})::BIGINT"
_BOXES = " UNION ALL ".join(f"SELECT vec_id, {k} AS k, {_AT(4 * k)} AS x, {_AT(4 * k + 1)} AS y, abs({_AT(4 * k + 2)}) AS w, abs({_AT(4 * k + 3)}) AS h FROM embeddings WHERE len(embedding) >= 16" for k in range(4))
ORACLES["main_person_box"] = f"""WITH b AS ({_BOXES}), s AS (SELECT *, w * h / 307200::DOUBLE * {d(0.75)} + ({d(1)} - least(sqrt((x + w / {d(2)} - 320) * (x + w / {d(2)} - 320) + (y + h / {d(2)} - 240) * (y + h / {d(2)} - 240)) / {d(400)}, {d(1)})) * {d(0.25)} AS score FROM b)
SELECT vec_id, x, y, w, h FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, k) = 1"""
ORACLES["crop_geometry"] = f"""WITH g AS (SELECT vec_id, vec_id * 37 % 1900 + 50 AS w, vec_id * 53 % 1400 + 50 AS h FROM embeddings), s AS (SELECT *, greatest(1, least(1024, w, h)) AS side FROM g)
SELECT vec_id, greatest(0, least(floor(w * {d(0.5)})::BIGINT - side // 2, w - side))::INTEGER AS left_edge, greatest(0, least(floor(h * {d(0.55)})::BIGINT - side // 2, h - side))::INTEGER AS top_edge, side::INTEGER AS side FROM s"""

# --- review --------------------------------------------------------------------

_LATEST = """latest AS (SELECT user_id::VARCHAR AS photo_id, event_id, CASE event_type WHEN 'click' THEN 'post' WHEN 'view' THEN 'save' WHEN 'error' THEN 'delete' ELSE 'undecided' END AS final_decision
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""
ORACLES["decisions_latest"] = ORACLES["stream_decisions"] = f"WITH {_LATEST} SELECT photo_id, event_id, final_decision FROM latest"
_REVIEWED = f"""{_LATEST}, reviewed AS (SELECT c_custkey::VARCHAR AS photo_id, c_custkey, c_name || '.jpg' AS filename, '/photos/' || c_name || '.jpg' AS original_path,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'selected' WHEN 'AUTOMOBILE' THEN 'selected' WHEN 'MACHINERY' THEN 'rejected' ELSE 'review' END AS ai_status, coalesce(l.final_decision, 'undecided') AS final_decision,
  'CL' || c_nationkey AS cluster_id, c_custkey % 7 = 0 AS is_cluster_winner, c_acctbal::DOUBLE AS final_score, c_mktsegment || '|' || c_name AS reasons FROM customer LEFT JOIN latest l ON l.photo_id = c_custkey::VARCHAR)"""
ORACLES["review_merge"] = f"WITH {_REVIEWED} SELECT photo_id, filename, ai_status, final_decision, cluster_id, is_cluster_winner, final_score, reasons FROM reviewed"
_BY = ", ".join(f"count(*) FILTER (final_decision = '{x}') AS {x}" if x != "delete" else "count(*) FILTER (final_decision = 'delete') AS \"delete\"" for x in ("post", "save", "delete", "undecided"))
ORACLES["review_progress"] = f"WITH {_REVIEWED} SELECT count(*) AS total, {_BY}, " + ", ".join(f"count(*) FILTER (ai_status = '{x}') AS ai_{x}" for x in ("selected", "review", "rejected")) + " FROM reviewed"
ORACLES["review_bucket"] = f"WITH {_REVIEWED} SELECT photo_id, final_decision FROM reviewed WHERE ai_status = 'review'"
ORACLES["export_counts"] = f"WITH {_REVIEWED} SELECT {_BY}, count(*) FILTER (final_decision <> 'undecided' AND c_custkey % 4 = 0) AS missing FROM reviewed"
ORACLES["review_mixed_rows"] = """WITH m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 <> 0 THEN c_custkey::VARCHAR END AS id, CASE WHEN c_custkey % 3 <> 0 THEN 'p' || c_custkey END AS pid, CASE WHEN c_custkey % 5 <> 0 THEN '/a/' || c_name || '.jpg' END AS path,
  CASE WHEN c_custkey % 7 <> 0 THEN c_name || '.JPG' END AS fname, c_nationkey, c_acctbal, c_name FROM customer),
n AS (SELECT *, coalesce(fname, CASE WHEN path IS NOT NULL THEN c_name || '.jpg' END, 'unknown') AS name FROM m)
SELECT coalesce(id, pid, path, name) AS photo_id, name AS filename, path AS original_path, CASE WHEN k % 2 <> 0 THEN 'selected' ELSE 'rejected' END AS ai_status, CASE WHEN k % 3 <> 0 THEN 'CL' || c_nationkey ELSE 'G1' END AS cluster_id,
  k % 4 = 0 OR k % 6 = 0 AS is_cluster_winner, CASE WHEN k % 5 <> 0 THEN c_acctbal ELSE k::DOUBLE END AS final_score, CASE WHEN k % 3 <> 0 THEN 'one|two' ELSE 'note' END AS reasons FROM n"""
ORACLES["decision_copies"] = f"""WITH {_REVIEWED} SELECT original_path AS source, '/out/02_FINAL_DECISION/' || CASE final_decision WHEN 'post' THEN 'Posts' WHEN 'save' THEN 'Save' ELSE 'Delete' END || '/' ||
  CASE WHEN final_decision = 'post' AND c_custkey % 5 = 0 THEN replace(filename, '.jpg', '_1.jpg') ELSE filename END AS destination FROM reviewed WHERE final_decision <> 'undecided'"""
ORACLES["collision_existing"] = """WITH p AS (SELECT p_partkey, replace(p_name, ' ', '-') AS stem FROM part), u AS (SELECT DISTINCT stem, 0 AS u FROM p WHERE p_partkey % 3 = 0 UNION SELECT DISTINCT stem, 2 FROM p WHERE p_partkey % 7 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) AS nth FROM p), free AS (SELECT stem, g, row_number() OVER (PARTITION BY stem ORDER BY g) AS nth FROM (SELECT stem, unnest(range(0, count(*) + 3)) AS g FROM p GROUP BY stem) x WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.stem = x.stem AND u.u = x.g))
SELECT p_partkey, stem || CASE WHEN g = 0 THEN '' ELSE '_' || g END || '.jpg' AS destination_name FROM n JOIN free USING (stem, nth)"""
ORACLES["neighbours_of_item"] = """WITH c AS (SELECT c_custkey AS k FROM customer), e AS (SELECT min(k) AS lo, max(k) AS hi FROM c)
SELECT 'last' AS asked, 1 AS step, lo::VARCHAR AS photo_id FROM e UNION ALL SELECT 'last', -1, max(k)::VARCHAR FROM c WHERE k < (SELECT hi FROM e) UNION ALL SELECT 'first', 1, min(k)::VARCHAR FROM c WHERE k > (SELECT lo FROM e)
UNION ALL SELECT 'first', -1, hi::VARCHAR FROM e UNION ALL SELECT 'unknown', 1, lo::VARCHAR FROM e UNION ALL SELECT 'unknown', -1, lo::VARCHAR FROM e"""
ORACLES["first_summary"] = f"""{picked()} SELECT count(*) AS total_photos, count(*) FILTER (status = 'selected') AS selected_count, count(*) FILTER (status = 'review') AS review_count, count(*) FILTER (status = 'rejected') AS rejected_count,
  count(*) FILTER (global_blur_penalty > 0.55) AS blurry_count, 0::BIGINT AS underexposed_count, 0::BIGINT AS overexposed_count, count(DISTINCT CASE WHEN cluster_size > 1 THEN cluster_id END) AS duplicate_groups_count FROM picked"""
ORACLES["shown_of"] = "SELECT p_partkey, (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) AS shown_of FROM part WHERE p_partkey % 2 = 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 120"
ORACLES["result_summary"] = f"""{picked()} SELECT 'balanced' AS mode, count(*)::DOUBLE AS "totalPhotos", (count(*) FILTER (status = 'selected'))::DOUBLE AS "selectedCount", (count(*) FILTER (status = 'review'))::DOUBLE AS "reviewCount",
  (count(*) FILTER (status = 'rejected'))::DOUBLE AS "rejectedCount", count(DISTINCT cluster_id)::DOUBLE AS "clusterCount", {r(f"sum(floor(final_score * {d(10000)} + {d(0.5)})::BIGINT)::DOUBLE / {d(10000)} / count(*)")} AS "averageFinalScore" FROM picked"""
ORACLES["report_json"] = f"""{picked()} SELECT photo_id, file_name AS filename, status, cluster_id AS "clusterId", CASE WHEN rank = 1 THEN 'true' ELSE 'false' END AS "isClusterWinner", win_file_name AS "clusterWinnerFilename", final_score AS "finalScore",
  {r(f"final_score * {d(100)}", 2)} AS "scorePercent", global_blur_penalty AS "globalBlurPenalty", face_count::DOUBLE AS "faceCount", subject_score AS "subjectScore" FROM picked"""
ORACLES["audit_records"] = ORACLES["report_rows"].removesuffix(" FROM picked") + f""", NULL::VARCHAR AS "outputPath", NULL::VARCHAR AS "thumbnailPath", win_file_name AS "clusterWinnerFilename", score_gap AS "scoreGapFromWinner",
  {reason_sql("balanced")} AS "reasonsList", sharpness, face_score AS "faceScore", true AS "personDetected", duplicate_penalty AS "duplicatePenalty" FROM picked"""
ORACLES["cluster_winners"] = f"""{picked()} SELECT cluster_id, max(CASE WHEN rank = 1 THEN photo_id END) AS selected, max(CASE WHEN rank = 1 THEN file_name END) AS winner_name, max(CASE WHEN rank = 1 THEN status END) AS winner_status,
  max(CASE WHEN rank = 1 THEN final_score END) AS best_score, count(*) AS photos FROM picked GROUP BY cluster_id"""
ORACLES["cluster_json"] = f"""{picked()} SELECT cluster_id, max(CASE WHEN rank = 1 THEN photo_id END) AS selected, string_agg(photo_id, ',' ORDER BY rank > 1, final_score DESC, photo_id) AS photos, max(CASE WHEN rank = 1 THEN final_score END) AS best_score FROM picked GROUP BY cluster_id"""
ORACLES["decision_json"] = f"""WITH {_REVIEWED}, placed AS (SELECT *, ((row_number() OVER (PARTITION BY cluster_id ORDER BY photo_id)) - 1) // 1000 AS part FROM reviewed), w AS (SELECT cluster_id, min(photo_id) FILTER (is_cluster_winner) AS winner FROM reviewed GROUP BY cluster_id)
SELECT cluster_id, part::INTEGER AS part, winner, string_agg(photo_id, ',' ORDER BY photo_id) AS ids, string_agg(ai_status, ',' ORDER BY photo_id) AS statuses, string_agg(final_decision, ',' ORDER BY photo_id) AS decisions FROM placed JOIN w USING (cluster_id) GROUP BY ALL"""
ORACLES["missing_files"] = f"WITH {_REVIEWED} SELECT photo_id, original_path FROM reviewed WHERE c_custkey % 4 = 0"
ORACLES["collision_names"] = """SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN n = 1 THEN '' ELSE '_' || (n - 1) END || '.jpg' AS destination_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)"""
ORACLES["ring_navigation"] = """SELECT conv_id, turn, coalesce(lead(turn) OVER w, first_value(turn) OVER w) AS next_id, coalesce(lag(turn) OVER w, last_value(turn) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
ORACLES["result_filter"] = "SELECT p_partkey, p_name AS filename, p_retailprice AS final_score FROM part WHERE p_size * 6 >= 50 AND NOT p_size < 20 AND p_partkey % 2 = 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 60"
ORACLES["name_search"] = "SELECT p_partkey, p_name AS filename FROM part WHERE regexp_matches(p_name, '^[a-m].*e', 'i')"

# --- files and cache -------------------------------------------------------------

_CACHE = f"""now AS (SELECT '/photos/e' || event_id || '.jpg' AS path, floor(value * {d(100)})::BIGINT AS file_size, epoch_us(ts) AS modified, event_id n FROM events), hit AS (SELECT * FROM now WHERE n % 3 <> 0 AND n % 5 <> 0 AND n % 7 <> 0 AND n % 11 <> 0 AND n % 13 <> 0 AND n % 17 <> 0)"""
ORACLES["cache_hits"] = f"WITH {_CACHE} SELECT path, file_size, modified FROM hit"
ORACLES["cache_misses"] = f"WITH {_CACHE} SELECT path, file_size, modified FROM now WHERE n NOT IN (SELECT n FROM hit)"
ORACLES["cache_keys"] = f"WITH {_CACHE} SELECT path, sha1(lower(path)) AS cache_key, sha1(path || '|' || file_size || '|' || modified) AS photo_id FROM now"
_FILES = """files AS (SELECT page_id, (['trip', '01_SELECTED', 'x_CULLED', 'home/album'])[(page_id // 5) % 4 + 1] AS folder, page_id::VARCHAR AS stem, (['.jpg', '.JPEG', '.png', '.gif', '.txt'])[page_id % 5 + 1] AS suffix FROM pages)"""
ORACLES["path_parts"] = f"WITH {_FILES} SELECT page_id, stem || suffix AS name, stem, suffix, folder AS parent FROM files"
ORACLES["scan_filter"] = f"WITH {_FILES} SELECT page_id, folder || '/' || stem || suffix AS path FROM files WHERE page_id % 5 < 3 AND folder IN ('trip', 'home/album')"
ORACLES["extensions_distinct"] = f"WITH {_FILES} SELECT DISTINCT lower(suffix) AS extension FROM files"

# --- smaller views -----------------------------------------------------------------

_PB = " UNION ALL ".join(f"SELECT vec_id, {k} AS k, abs(floor(embedding[{3 * k + 1}]::DOUBLE * {d(100)})::BIGINT) * abs(floor(embedding[{3 * k + 2}]::DOUBLE * {d(100)})::BIGINT) AS area, {r(f'embedding[{3 * k + 3}]::DOUBLE * {d(200)}')} AS s FROM embeddings WHERE len(embedding) >= 9" for k in range(3))
ORACLES["person_blur_stats"] = f"""WITH b AS (SELECT * FROM ({_PB}) WHERE area > 0), g AS (SELECT vec_id, count(*) AS persons, {r("arg_max(s, area * 10 - k)", 2)} AS main,
  {r("list_sum(list(s ORDER BY k) FILTER (s > 0)) / count(*) FILTER (s > 0)", 2)} AS mean_blur, {r("min(s) FILTER (s > 0)", 2)} AS least FROM b GROUP BY vec_id)
SELECT e.vec_id, coalesce(persons, 0)::INTEGER AS persons, main, mean_blur, least FROM embeddings e LEFT JOIN g ON g.vec_id = e.vec_id WHERE len(e.embedding) >= 9"""
ORACLES["cluster_models"] = f"""{picked()} SELECT cluster_id, string_agg(photo_id, ',' ORDER BY lower(file_name), photo_id) AS photo_ids, max(CASE WHEN rank = 1 THEN photo_id END) AS selected_photo_id,
  coalesce(string_agg(photo_id, ',' ORDER BY lower(file_name), photo_id) FILTER (status = 'rejected'), '') AS rejected_photo_ids, count(*) AS size FROM picked GROUP BY cluster_id"""
ORACLES["ungrouped_clusters"] = "SELECT s_suppkey AS id, printf('CL%04d', row_number() OVER (ORDER BY s_suppkey)) AS cluster_id, 1::BIGINT AS cluster_size, 0::DOUBLE AS confidence FROM supplier"
ORACLES["typed_reason_rows"] = f"""{picked()} SELECT photo_id, CASE status WHEN 'selected' THEN 'positive' ELSE 'negative' END AS type, upper(status) || '_REASON' AS code, len(string_split({reason_sql("balanced")}, '; ')) - CASE WHEN cluster_size <= 1 THEN 1 ELSE 0 END
  - CASE WHEN cluster_size > 1 AND rank > 1 THEN 1 ELSE 0 END AS n FROM picked WHERE status <> 'review'"""
ORACLES["decision_report"] = f"WITH {_REVIEWED} SELECT photo_id, filename, original_path, ai_status, final_decision, cluster_id, is_cluster_winner, final_score, 0::DOUBLE AS face_score, 0::DOUBLE AS body_sharpness, 0::DOUBLE AS body_blur_penalty, 'user' AS decision_source, replace(reasons, '|', '; ') AS reasons FROM reviewed"
ORACLES["filter_choices"] = "SELECT DISTINCT upper(split_part(p_type, ' ', 1)) AS choice FROM part WHERE p_type IS NOT NULL"
ORACLES["log_tail"] = "SELECT event_id, user_id::VARCHAR AS photo_id, CASE event_type WHEN 'click' THEN 'post' WHEN 'view' THEN 'save' WHEN 'error' THEN 'delete' ELSE 'undecided' END AS final_decision FROM events ORDER BY ts DESC, event_id DESC LIMIT 20"
ORACLES["display_rows"] = "SELECT upper(split_part(p_type, ' ', 1)) AS status, CASE WHEN p_size < 20 THEN 'Blur' ELSE 'Sharp' END AS blur_level, count(*) AS n FROM part GROUP BY ALL"
ORACLES["display_paths"] = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '/t/' || p_partkey WHEN p_partkey % 2 = 0 THEN '/o/' || p_partkey END AS list_path,
  CASE WHEN p_partkey % 2 = 0 THEN '/o/' || p_partkey WHEN p_partkey % 3 = 0 THEN '/t/' || p_partkey END AS full_path FROM part"""
ORACLES["cache_after_run"] = f"""WITH {_CACHE}, fresh AS (SELECT * FROM now WHERE n NOT IN (SELECT n FROM hit) AND file_size % 10 <> 0)
SELECT path, file_size, modified FROM fresh UNION ALL SELECT path, file_size + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END, modified + CASE WHEN n % 7 = 0 THEN 10000000 ELSE 0 END FROM now WHERE n % 3 <> 0 AND n NOT IN (SELECT n FROM fresh)"""
ORACLES["item_lookup"] = f"WITH {_REVIEWED} SELECT photo_id, filename, ai_status FROM reviewed WHERE c_custkey = 7"

_BOXES = f"""WITH {TILES}, sums AS (SELECT vec_id, x, y, sum(v) AS s, sum(v * v) AS q, sum(v) FILTER (i BETWEEN 1 AND 2 AND j BETWEEN 1 AND 2) AS inner_s, sum(v) FILTER (i < 2) AS upper_s, sum(v) FILTER (i >= 2) AS lower_s
  FROM (SELECT vec_id, x, y, i, j, px[(y + i) * 8 + x + j + 1] AS v FROM tiles, range(5) a(x), range(5) b(y), range(4) c(i), range(4) d(j)) GROUP BY ALL),
boxes AS (SELECT vec_id, x::INTEGER AS x, y::INTEGER AS y, 4 AS w, 4 AS h FROM (SELECT *, sqrt(greatest(q / 16::DOUBLE - (s / 16::DOUBLE) * (s / 16::DOUBLE), {d(0)})) AS spread FROM sums)
  WHERE {d(0)} + {d(1)} * (inner_s / 4::DOUBLE) + {d(-1)} * (s / 16::DOUBLE) >= {d(0.5)} * spread AND {d(0)} + {d(1)} * (upper_s / 8::DOUBLE) + {d(-1)} * (lower_s / 8::DOUBLE) >= {d(0)} * spread)"""
ORACLES["tile_boxes"] = f"{_BOXES} SELECT vec_id, x, y, w, h FROM boxes"
ORACLES["tile_box_faces"] = f"{_BOXES} SELECT tiles.vec_id, count(boxes.vec_id)::INTEGER AS face_count, count(boxes.vec_id) > 0 AS face_detected FROM tiles LEFT JOIN boxes ON boxes.vec_id = tiles.vec_id GROUP BY tiles.vec_id"

_RENAMED = {
    "path": "original_path", "is_blurry": "is_blur", "brightness": "brightness_score", "duplicate_group": "CASE WHEN is_duplicate_candidate THEN duplicate_group_id END",
    "is_best_in_duplicate_group": "best_in_duplicate_group", "status": "output_status",
}
ORACLES["first_report_rows"] = f"""SELECT {", ".join(f"{_RENAMED.get(c, c)} AS {c}" for c in FIRST_COLUMNS)} FROM ({ORACLES["flat_report_rows"]})"""
