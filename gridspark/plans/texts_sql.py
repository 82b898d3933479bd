"""SQL shared by the text and job queries."""

NAME_PARAMETERS_SQL = """SELECT run, s_suppkey,
  nullif(regexp_extract(run, 'U(-?[0-9]+)', 1), '') AS U_raw, CAST(nullif(regexp_extract(run, 'U(-?[0-9]+)', 1), '') AS DOUBLE) / 100 AS U0,
  nullif(regexp_extract(run, 'N([0-9]+)', 1), '') AS N_raw,
  CASE WHEN regexp_matches(run, 'alpha[0-9]+') THEN CAST(nullif(regexp_extract(run, 'N([0-9]+)', 1), '') AS DOUBLE) / 100000
    ELSE CAST(nullif(regexp_extract(run, 'N([0-9]+)', 1), '') AS DOUBLE) / 10000 END AS N0,
  CAST(nullif(regexp_extract(run, 'Amp([0-9]+)', 1), '') AS DOUBLE) AS height,
  CAST(nullif(regexp_extract(run, 'f([0-9]+)', 1), '') AS DOUBLE) / 1000000 AS f0,
  CAST(nullif(regexp_extract(run, 'B([0-9]+)', 1), '') AS DOUBLE) AS B,
  CAST(nullif(regexp_extract(run, 'alpha([0-9]+)', 1), '') AS DOUBLE) / 100 AS alpha,
  CAST(nullif(regexp_extract(run, 'u([0-9]+)', 1), '') AS DOUBLE) / 100 AS flow FROM names"""

STATUS_SQL = """SELECT ord, run, COALESCE(string_agg(label, '  ' ORDER BY pos) FILTER (pos IS NOT NULL), '') AS job_states,
  COALESCE(string_agg(job_id, ' ' ORDER BY pos) FILTER (pos IS NOT NULL), '') AS job_ids, COALESCE(bool_or(state = 'RUNNING'), FALSE) AS running,
  arg_max(elapsed, pos) FILTER (state = 'RUNNING') AS elapsed
FROM (SELECT ord, run, pos, u.job_id, state, elapsed, CASE
    WHEN state = 'PENDING' AND pos = min(CASE WHEN state = 'PENDING' THEN pos END) OVER (PARTITION BY ord) THEN u.job_id || ': PENDING ' || reason
    WHEN state = 'PENDING' THEN u.job_id WHEN state = 'COMPLETED' THEN u.job_id || ': done: ' || exit_code
    ELSE u.job_id || ': ' || COALESCE(state, 'unknown') END AS label
  FROM (SELECT j.ord, j.run, n AS pos, job_ids[n + 1] AS job_id FROM job_log j LEFT JOIN range(3) r(n) ON n < len(job_ids)) u
  LEFT JOIN accounting USING (job_id)) GROUP BY ord, run"""

PROGRESS_SQL = """SELECT run, secs AS model_seconds, secs / 24 / 3600 AS model_days, cfl_u, cfl_v, cfl_w,
  CASE WHEN secs IS NULL THEN 'no output yet' ELSE format('{:.2f} days', secs / 24 / 3600) END AS note
FROM (SELECT run, arg_max(value, ord) FILTER (metric = 'time_secondsf') AS secs,
  arg_max(value, ord) FILTER (metric = 'advcfl_uvel_max') AS cfl_u, CAST(arg_max(value, ord) FILTER (metric = 'advcfl_vvel_max') AS DOUBLE) AS cfl_v,
  arg_max(value, ord) FILTER (metric = 'advcfl_wvel_max') AS cfl_w FROM metrics GROUP BY run)"""
