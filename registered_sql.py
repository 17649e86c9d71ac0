"""DuckDB statements that say independently what each registered query must return.

Greedy selections are plain greedy over the full similarity kernel, as recursive queries.
"""

from __future__ import annotations

import math

from mixloom.config import SUBMIXTURES, TEMPLATE_TYPES
from mixloom.sources import samples

CONVERSATION_PAIRS = """
SELECT conv_id, turn, conv_id * 1000 + turn AS row_idx, text AS inputs, nxt AS targets,
 'conversations' AS submixture, 'conversations' AS task_source, 'dialog' AS task_name, 'zs_noopt' AS template_type
FROM (SELECT conv_id, turn, role, text, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole
      FROM {conversations} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) z
WHERE role = 'user' AND nrole = 'assistant'
"""

KNOWN = ", ".join(f"'{t}'" for t in TEMPLATE_TYPES)
GROUP = "submixture, task_name, template_type"
TASK = "submixture, task_name"
TASKS, ROWS = 6, 250


def _ord(submixtures) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(submixtures))
    return f"CASE submixture {cases} END"


def _source(template: str) -> str:
    return template.format(**{n: n for n in ("embeddings", "documents", "conversations", "lineitem")})


INST = f"inst AS ({_source(samples.VECTOR_INSTANCES)})"
DOCS = f"docs AS ({_source(samples.DOCUMENT_INSTANCES)})"
PAIRS = f"pairs AS ({_source(CONVERSATION_PAIRS)})"
TRAIN = "train AS (SELECT conv_id, turn, row_idx, inputs AS prompt, targets AS response FROM pairs WHERE conv_id % 10 <> 0)"
LOSSES = f"losses AS ({_source(samples.BATCH_LOSSES)})"
KNOWN_ROWS = f"known AS (SELECT * FROM inst WHERE template_type IN ({KNOWN}))"
BASE = f"{INST}, {KNOWN_ROWS}"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def totals(submixtures=SUBMIXTURES) -> str:
    """Per task: position, rows, rows per template."""
    counts = ", ".join(f"count(*) FILTER (template_type = '{t}') AS {t}" for t in TEMPLATE_TYPES)
    return f"""
firsts AS (SELECT {TASK}, min(row_idx) AS first_row FROM inst GROUP BY {TASK}),
tot AS (SELECT k.*, f.first_row, row_number() OVER (ORDER BY {_ord(submixtures)}, f.first_row) - 1 AS task_pos
        FROM (SELECT {TASK}, count(*) AS total, {counts} FROM known GROUP BY {TASK}) k JOIN firsts f USING ({TASK}))"""


MEANS = f"""
cells AS (SELECT {TASK}, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM known),
means AS (SELECT {TASK}, p, avg(v) AS v FROM cells GROUP BY {TASK}, p)"""

TASK_KERNEL = f"""
units AS (SELECT t.task_pos, p, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY t.task_pos)), 0) AS v
          FROM means JOIN tot t USING ({TASK})),
k AS MATERIALIZED (SELECT 0 AS g, a.task_pos AS i, b.task_pos AS j, coalesce(sum(a.v * b.v), 0) AS s
      FROM units a JOIN units b USING (p) GROUP BY a.task_pos, b.task_pos)"""


def row_kernel(rows: str = "known", key: str = GROUP) -> str:
    """Kernel of rows inside each group; g numbers the groups, i and j are row_idx."""
    on = " AND ".join(f"a.{c} = b.{c}" for c in key.split(", "))
    return f"""
norm AS MATERIALIZED (SELECT {key}, row_idx, embedding::DOUBLE[] AS e,
         sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l,
         dense_rank() OVER (ORDER BY {key}) AS g FROM {rows}),
k AS MATERIALIZED (SELECT a.g, a.row_idx AS i, b.row_idx AS j,
         CASE WHEN a.l > 0 AND b.l > 0 THEN list_inner_product(a.e, b.e) / (a.l * b.l) ELSE 0 END AS s
      FROM norm a JOIN norm b ON {on})"""


def greedy(objective: str, limit: str = "1000000", name: str = "picks") -> str:
    """{name}(g, step, j, gain) of plain greedy on k(g, i, j, s)."""
    st = f"{name}_st"
    if objective == "gc":
        order = "(PARTITION BY g ORDER BY round(gain, 9) DESC, j)"
        return f"""
{name}_base AS (SELECT g, j, sum(s) - 0.4::DOUBLE * sum(CASE WHEN i = j THEN s ELSE 0 END) AS gain FROM k GROUP BY g, j),
{st} AS (
  SELECT g, j, gain, 1 AS step, first_value(j) OVER {order} AS p FROM {name}_base
  UNION ALL
  SELECT g, j, gain, step, first_value(j) OVER {order} AS p FROM (
    SELECT a.g, a.j, a.gain - 0.8::DOUBLE * k.s AS gain, a.step + 1 AS step
    FROM {st} a JOIN k ON k.g = a.g AND k.i = a.p AND k.j = a.j WHERE a.j <> a.p AND a.step < {limit})),
{name} AS (SELECT g, step, j, gain FROM {st} WHERE j = p)"""
    if objective == "fl":
        inner = f"""SELECT *, max(CASE WHEN j = p THEN u END) OVER (PARTITION BY g, i) AS up FROM (
      SELECT *, first_value(j) OVER (PARTITION BY g ORDER BY round(gain, 9) DESC, j) AS p FROM (
        SELECT *, sum(u) OVER (PARTITION BY g, j) AS gain FROM {st}))"""
        return f"""
{st} AS (
  SELECT g, i, j, greatest(s, 0::DOUBLE) AS u, 1 AS step FROM k
  UNION ALL
  SELECT g, i, j, greatest(u - up, 0::DOUBLE) AS u, step + 1 FROM ({inner}) WHERE j <> p AND step < {limit}),
{name} AS (SELECT g, step, j, gain FROM (
   SELECT *, row_number() OVER (PARTITION BY g, step ORDER BY round(gain, 9) DESC, j) AS rn
   FROM (SELECT g, step, j, sum(u) AS gain FROM {st} GROUP BY g, step, j)) WHERE rn = 1)"""
    diag = "ORDER BY (CASE WHEN i = j THEN round(ln(r), 9) END) DESC NULLS LAST, j"
    inner = f"""SELECT *, max(CASE WHEN j = p THEN r END) OVER (PARTITION BY g, i) AS rip,
       max(CASE WHEN i = p THEN r END) OVER (PARTITION BY g, j) AS rpj,
       max(CASE WHEN i = p AND j = p THEN r END) OVER (PARTITION BY g) AS rpp
     FROM (SELECT *, first_value(j) OVER (PARTITION BY g {diag}) AS p FROM {st})"""
    return f"""
{st} AS (
  SELECT g, i, j, s + (CASE WHEN i = j THEN 1 ELSE 0 END) AS r, 1 AS step FROM k
  UNION ALL
  SELECT g, i, j, r - rip * rpj / rpp AS r, step + 1 FROM ({inner}) WHERE i <> p AND j <> p AND step < {limit}),
{name} AS (SELECT g, step, j, ln(r) AS gain FROM (
   SELECT *, row_number() OVER (PARTITION BY g, step ORDER BY round(ln(r), 9) DESC, j) AS rn
   FROM {st} WHERE i = j) WHERE rn = 1)"""


def random_tasks(count: int = TASKS, seed: int = 23) -> str:
    return f"""
tp AS (SELECT row_number() OVER (ORDER BY d, {TASK}) AS pick, {TASK}, total, 1.0::DOUBLE AS gain
       FROM (SELECT *, md5(concat('{seed}:', submixture, ':', task_name)) AS d FROM tot) ORDER BY pick LIMIT {count})"""


def task_picks(objective: str, count: int = TASKS, seed: int = 23) -> str:
    """tp(pick, task..., total, gain); the kernel CTE k must be gone or scoped, so it is inlined."""
    if objective == "random":
        return random_tasks(count, seed)
    body = f"{MEANS},{TASK_KERNEL},{greedy(objective, str(count))}"
    return f"""
tp AS (WITH RECURSIVE {body.strip()}
  SELECT p.step AS pick, t.submixture, t.task_name, t.total, p.gain FROM picks p JOIN tot t ON t.task_pos = p.j)"""


def budgets(rows: str, by: str = "", order: int = 2, temperature: float = 1.0) -> str:
    """bt(task..., budget, ...) from tp: softmax, integer split, cap and redistribute."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    using = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    taylor = " + ".join(f"pow(gain, {k}) / {math.factorial(k)}.0::DOUBLE" for k in range(1, order + 1))
    return f"""
w AS (SELECT *, 1.0::DOUBLE + {taylor} AS w FROM (SELECT * REPLACE (gain / {temperature}::DOUBLE AS gain) FROM tp)),
q AS (SELECT *, floor(round({rows}::DOUBLE * w / sum(w) OVER ({part}), 9))::BIGINT AS f FROM w),
s0 AS (SELECT *, f + CASE WHEN row_number() OVER ({part} ORDER BY pick) <= {rows} - sum(f) OVER ({part}) THEN 1 ELSE 0 END AS b FROM q),
{fill('s0', 'b', 'total', 'pick', by)}"""


def fill(source: str, budget: str, cap: str, order: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    using = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    return f"""c AS (SELECT *, least({budget}, {cap}) AS kept, greatest({budget} - {cap}, 0) AS x, {cap} - least({budget}, {cap}) AS h FROM {source}),
r AS (SELECT {lead}sum(x) AS r FROM c {group}),
hs AS (SELECT {lead}h, row_number() OVER ({part} ORDER BY h, {order}) - 1 AS i, count(*) OVER ({part}) AS n,
       coalesce(sum(h) OVER ({part} ORDER BY h, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM c WHERE h > 0),
lv AS (SELECT {lead}arg_min((r - cum) // (n - i), i) AS lev, arg_min((r - cum) % (n - i), i) AS rem
       FROM hs JOIN r {using} WHERE cum + h * (n - i) >= r {group}),
bt AS (SELECT c.*, (kept + coalesce(least(lev, h), 0) + CASE WHEN h > lev AND
          sum(CASE WHEN h > lev THEN 1 ELSE 0 END) OVER ({part.replace(by, 'c.' + by) if by else ''} ORDER BY {order}) <= rem THEN 1 ELSE 0 END)::BIGINT AS budget
       FROM c LEFT JOIN lv {using})"""


def _split2(total: str, a: str, b: str) -> tuple[str, str]:
    first = f"(CASE WHEN {a} + {b} > 0 THEN ({total} * {a} + {a} + {b} - 1) // ({a} + {b}) ELSE 0 END)"
    return first, f"(CASE WHEN {a} + {b} > 0 THEN {total} - {first} ELSE 0 END)"


def split_templates(extra: str = "") -> str:
    """tb(task..., template_type, rows, budget) from bt and tot."""
    zs, fs = _split2("budget", "(zs_opt + zs_noopt)", "(fs_opt + fs_noopt)")
    a, b = _split2("zs", "zs_opt", "zs_noopt")
    c, d = _split2("fs", "fs_opt", "fs_noopt")
    lead = f"{extra}, " if extra else ""
    selects = " UNION ALL ".join(
        f"SELECT {lead}{TASK}, '{t}' AS template_type, {t} AS rows, ({x})::BIGINT AS budget FROM hv WHERE {t} > 0"
        for t, x in zip(TEMPLATE_TYPES, (a, b, c, d))
    )
    prefix = f"bt.{extra}, " if extra else ""
    return f"""
hv AS (SELECT {prefix}tot.*, bt.budget, {zs.replace('budget', 'bt.budget')} AS zs, {fs.replace('budget', 'bt.budget')} AS fs
       FROM bt JOIN tot USING ({TASK})),
tb AS ({selects})"""


def row_order(objective: str, seed: int = 69) -> str:
    """ro(group..., rank, row_idx, gain) over known rows."""
    if objective == "random":
        return f"""
ro AS (SELECT {GROUP}, row_number() OVER (PARTITION BY {GROUP} ORDER BY md5(concat('{seed}:', CAST(row_idx AS VARCHAR))), row_idx) AS rank,
       row_idx, 1.0::DOUBLE AS gain FROM known)"""
    body = f"{row_kernel()},{greedy(objective)}"
    return f"""
ro AS (WITH RECURSIVE {body.strip()}
  SELECT n.submixture, n.task_name, n.template_type, p.step AS rank, p.j AS row_idx, p.gain
  FROM picks p JOIN norm n ON n.g = p.g AND n.row_idx = p.j)"""


def chunk_order(objective: str, threshold: int, size: int) -> str:
    """co(group..., rank, row_idx, gain): chunks ordered apart and merged by (rank, chunk)."""
    placed = f"""
placed AS (SELECT *, CASE WHEN n > {threshold} THEN pl // {size} ELSE 0 END AS chunk_id FROM (
  SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY row_idx) - 1 AS pl, count(*) OVER (PARTITION BY {GROUP}) AS n FROM known))"""
    if objective == "random":
        ranked = f"""
ranked AS (SELECT *, 1.0::DOUBLE AS gain, row_number() OVER (PARTITION BY {GROUP}, chunk_id
  ORDER BY md5(concat('69:', CAST(row_idx AS VARCHAR))), row_idx) AS step FROM placed)"""
    else:
        body = f"{row_kernel('placed', GROUP + ', chunk_id')},{greedy(objective)}"
        ranked = f"""
ranked AS (WITH RECURSIVE {body.strip()}
  SELECT n.submixture, n.task_name, n.template_type, n.chunk_id, p.step, p.j AS row_idx, p.gain
  FROM picks p JOIN norm n ON n.g = p.g AND n.row_idx = p.j)"""
    return f"""{placed},{ranked},
co AS (SELECT {GROUP}, row_number() OVER (PARTITION BY {GROUP} ORDER BY step, chunk_id) AS rank, row_idx, gain FROM ranked)"""


SHUFFLED = "md5(concat('23:', submixture, ':', CAST(row_idx AS VARCHAR)))"
GAIN = "round(gain, 6) + 0.0 AS gain"


def mixture(f1: str, f2: str, tasks: int = TASKS, rows: int = ROWS, submixtures=SUBMIXTURES, base: str = BASE) -> str:
    return (
        _with(
            base,
            totals(submixtures).strip(),
            task_picks(f1, tasks).strip(),
            budgets(str(rows)).strip(),
            split_templates().strip(),
            row_order(f2).strip(),
            f"chosen AS (SELECT submixture, row_idx FROM ro JOIN tb USING ({GROUP}) WHERE rank <= budget)",
            recursive=True,
        )
        + f"""SELECT row_number() OVER (ORDER BY {SHUFFLED}) - 1 AS pos, submixture, row_idx, md5(inputs) AS prompt_md5
FROM chosen JOIN known USING (submixture, row_idx)"""
    )


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')"


def hashed(text: str, length: int) -> str:
    return (
        f"list_transform(list_slice({tokens(text)}, 1, {length}), "
        "lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 32767 + 1)"
    )


EMBEDDED = f"""
toks AS (SELECT row_idx, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS bucket FROM (
  SELECT row_idx, unnest({tokens('inputs')}) AS t FROM docs)),
cnt AS (SELECT row_idx, bucket, count(*) AS n FROM toks GROUP BY row_idx, bucket),
wts AS (SELECT row_idx, bucket, (n::DOUBLE / sqrt(sum(n * n) OVER (PARTITION BY row_idx)::DOUBLE))::FLOAT AS weight FROM cnt)"""

DOCUMENT_BASE = f"""{DOCS},{EMBEDDED},
dims AS (SELECT row_idx, list(coalesce(weight, 0::FLOAT) ORDER BY b) AS embedding
  FROM (SELECT docs.row_idx, b, weight FROM docs CROSS JOIN range(256) x(b)
        LEFT JOIN wts ON wts.bucket = b AND wts.row_idx = docs.row_idx) GROUP BY row_idx),
inst AS (SELECT docs.*, dims.embedding FROM docs JOIN dims USING (row_idx)), {KNOWN_ROWS}"""

PLAN = """
plan AS (SELECT *, (place // 4)::BIGINT AS batch_id FROM (
  SELECT epoch, row_idx, row_number() OVER (PARTITION BY epoch ORDER BY md5(concat('23:', epoch, ':', row_idx)), row_idx) - 1 AS place
  FROM train, range(2) e(epoch)))"""
EVAL_PLAN = """
train AS (SELECT row_idx, inputs AS prompt, targets AS response FROM pairs WHERE conv_id % 10 = 0),
plan AS (SELECT 0 AS epoch, row_idx, (row_number() OVER (ORDER BY row_idx) - 1) // 4 AS batch_id FROM train)"""
MASKED = f"""
ids AS (SELECT row_idx, {hashed("concat(prompt, ' ', response)", 512)} AS input_ids, {hashed("prompt", 512)} AS prompt_ids FROM train),
masked AS (SELECT row_idx, input_ids, len(input_ids) AS n,
  list_transform(input_ids, lambda x, i: CASE WHEN i <= len(prompt_ids) THEN -100 ELSE x END) AS labels FROM ids)"""


def _padded(column: str, fill_value: int, missing: str) -> str:
    return f"array_to_string(list_concat({column}, list_transform(range({missing}), lambda z: {fill_value}::BIGINT)), ',')"


GAINS = f"gains AS (SELECT {TASK}, avg(length(inputs)) / 1000 - 1 AS gain, count(*) AS total FROM docs GROUP BY {TASK})"


def _sweep(grid, result: str = "SELECT * FROM chosen", *more: str) -> str:
    """Every setting on its own, from the same parts; `result` reads their rows."""
    parts = []
    for i, cfg in enumerate(grid):
        body = ",\n".join(
            x.strip()
            for x in (
                task_picks(cfg.task_objective, cfg.num_tasks, cfg.task_seed),
                budgets(str(cfg.num_instances), order=cfg.taylor_order, temperature=cfg.temperature),
                split_templates(),
            )
        )
        parts.append(
            f"c{i} AS (WITH RECURSIVE {body} SELECT {i} AS config_id, {GROUP}, ro.row_idx FROM ro_{cfg.instance_objective}_{cfg.ordering_seed} ro"
            f" JOIN tb USING ({GROUP}) WHERE rank <= budget)"
        )
    orders = [
        row_order(f, seed).strip().replace("ro AS (", f"ro_{f}_{seed} AS MATERIALIZED (", 1)
        for f, seed in sorted({(c.instance_objective, c.ordering_seed) for c in grid})
    ]
    union = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(grid)))
    return _with(BASE, *more, totals().strip(), *orders, *parts, f"chosen AS ({union})", recursive=True) + result


def _written_sweep(grid) -> str:
    seeds = " ".join(f"WHEN {i} THEN '{c.shuffle_seed}:'" for i, c in enumerate(grid))
    digest = f"md5(concat(CASE config_id {seeds} END, submixture, ':', CAST(row_idx AS VARCHAR)))"
    result = f"""SELECT config_id, 'train' AS split, submixture, row_idx,
 row_number() OVER (PARTITION BY config_id ORDER BY {digest}) - 1 AS pos, inputs AS prompt, targets AS response
FROM chosen JOIN known USING (submixture, row_idx)
UNION ALL SELECT config_id, 'validation', submixture, row_idx, NULL, inputs, targets
FROM pairs, range({len(grid)}) t(config_id) WHERE conv_id % 10 = 0"""
    return _sweep(grid, result, PAIRS)


def _baseline(ratio: str) -> str:
    source = f"""
tp AS (SELECT {TASK}, total, task_pos AS pick, {ratio} AS ratio FROM tot),
q AS (SELECT *, floor(round({ROWS}::DOUBLE * ratio / sum(ratio) OVER (), 9))::BIGINT AS f FROM tp),
s0 AS (SELECT *, f + CASE WHEN row_number() OVER (ORDER BY pick) <= {ROWS} - sum(f) OVER () THEN 1 ELSE 0 END AS b FROM q),
{fill('s0', 'b', 'total', 'pick')}"""
    return (
        _with(BASE, totals().strip(), source.strip(), split_templates().strip(), row_order("random").strip())
        + f"SELECT {GROUP}, row_idx FROM ro JOIN tb USING ({GROUP}) WHERE rank <= budget"
    )


def _picked(objective: str) -> str:
    return _with(BASE, totals().strip(), task_picks(objective).strip(), recursive=True)


def _budgeted(objective: str) -> str:
    return _with(
        BASE, totals().strip(), task_picks(objective).strip(), budgets(str(ROWS)).strip(), split_templates().strip(), recursive=True
    )


def _ordered(objective: str) -> str:
    return _with(BASE, row_order(objective).strip(), recursive=True) + f"SELECT {GROUP}, rank, row_idx, {GAIN} FROM ro"


def _chunked(objective: str) -> str:
    return _with(BASE, chunk_order(objective, 20, 16).strip(), recursive=True) + f"SELECT {GROUP}, rank, row_idx, {GAIN} FROM co"


def statements(grid, written) -> dict[str, str]:
    """All statements; `grid` holds the settings of the sweep, `written` those of the datasets."""
    index = _with(BASE) + (
        f"SELECT {GROUP}, row_idx, row_number() OVER (PARTITION BY {GROUP} ORDER BY row_idx) - 1 AS place FROM known"
    )
    eval_loss = "sum(loss * n) / sum(n)"
    tasks = {f: _picked(f) + f"SELECT pick, {TASK}, {GAIN} FROM tp" for f in ("fl", "gc", "logdet", "random")}
    all_budgets = f"SELECT {TASK}, coalesce(budget, 0) AS budget FROM tot LEFT JOIN (SELECT {TASK}, budget FROM bt) USING ({TASK})"
    by_jobs = " UNION ALL ".join(
        f"SELECT '{f}' AS objective, * FROM ({tasks[f]})" for f in ("fl", "gc", "logdet")
    )
    taylor = " + ".join(f"pow(x, {k}) / {f}" for k, f in ((1, 1), (2, 2), (3, 6), (4, 24)))
    lengths = " UNION ALL ".join(
        f"SELECT row_idx, len({hashed(chr(99) + 'oncat(prompt, chr(32), response)', n)}) AS ids, {n} AS max_len FROM train"
        for n in (512, 1024, 48, 128)
    )
    updates = "(batches + 15) // 16"
    padded = f"""SELECT epoch, batch_id, row_idx, {_padded('input_ids', 0, 'm - n')} AS input_ids,
 {_padded('list_transform(input_ids, lambda y: 1::BIGINT)', 0, 'm - n')} AS attention_mask, {_padded('labels', -100, 'm - n')} AS labels
FROM (SELECT *, max(n) OVER (PARTITION BY epoch, batch_id) AS m FROM plan JOIN masked USING (row_idx))"""
    return {
        "load_submixtures": _with(DOCS)
        + """SELECT submixture, row_number() OVER (PARTITION BY submixture ORDER BY row_idx) - 1 AS row_idx, row_idx AS doc_id,
 task_name, md5(inputs) AS digest FROM docs WHERE row_idx % 10 <> 0""",
        "load_submixtures_split_column": _with(DOCS)
        + """SELECT 'all' AS submixture, row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, row_idx AS doc_id, task_name,
 md5(inputs) AS digest FROM docs WHERE row_idx % 10 <> 0""",
        "load_instruction_dataset": _with(PAIRS)
        + """SELECT CASE WHEN conv_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split, conv_id, turn,
 inputs AS prompt, targets AS response FROM pairs""",
        "stage_reuse": index,
        "written_ordering": _ordered("random"),
        "loaded_ordering": _ordered("gc"),
        "written_mixture": "SELECT 'train' AS split, * FROM ("
        + mixture("random", "random").replace("md5(inputs) AS prompt_md5", "inputs AS prompt, targets AS response")
        + ") UNION ALL SELECT 'validation', NULL, * FROM ("
        + _with(PAIRS)
        + "SELECT submixture, row_idx, inputs, targets FROM pairs WHERE conv_id % 10 = 0)",
        "written_metrics": _with(LOSSES)
        + f"""SELECT epoch, round({eval_loss}, 6) AS eval_loss, round(exp({eval_loss}), 6) AS perplexity,
 round(sum(loss) / count(*), 6) AS train_loss FROM losses GROUP BY epoch""",
        "input_violations": _with(BASE)
        + f"""SELECT 'null_submixture' AS rule, count(*) FILTER (submixture IS NULL) AS violations FROM inst
UNION ALL SELECT 'null_row_idx', count(*) FILTER (row_idx IS NULL) FROM inst
UNION ALL SELECT 'null_task_name', count(*) FILTER (task_name IS NULL) FROM inst
UNION ALL SELECT 'null_inputs', count(*) FILTER (inputs IS NULL) FROM inst
UNION ALL SELECT 'null_targets', count(*) FILTER (targets IS NULL) FROM inst
UNION ALL SELECT 'null_embedding', count(*) FILTER (embedding IS NULL) FROM inst
UNION ALL SELECT 'ragged_embedding', coalesce(sum(n) - max(n), 0)::BIGINT FROM (SELECT len(embedding) AS w, count(*) AS n FROM inst WHERE embedding IS NOT NULL GROUP BY w)
UNION ALL SELECT 'not_finite_embedding', count(*) FILTER (list_bool_or([v IS NULL OR NOT isfinite(v) FOR v IN embedding])) FROM inst
UNION ALL SELECT 'repeated_row', count(*) - count(DISTINCT (submixture, row_idx)) FROM inst
UNION ALL SELECT 'num_tasks', CAST(count(DISTINCT ({TASK})) <= 10 AS BIGINT) FROM known
UNION ALL SELECT 'num_instances', CAST(count(*) < {ROWS} AS BIGINT) FROM known""",
        "known_templates": _with(BASE) + f"SELECT {GROUP}, row_idx FROM known",
        "decoded_labels": _with(INST) + "SELECT submixture, row_idx, task_name FROM inst",
        "row_positions": _with(DOCS)
        + "SELECT submixture, row_idx AS doc_id, row_number() OVER (PARTITION BY submixture ORDER BY row_idx) - 1 AS row_idx FROM docs",
        "row_positions_by_text": _with(DOCS)
        + """SELECT submixture, row_idx AS doc_id,
 row_number() OVER (PARTITION BY submixture ORDER BY md5(inputs), row_idx) - 1 AS row_idx FROM docs""",
        "stripped_metadata": _with(DOCS) + "SELECT submixture, row_idx, inputs, targets FROM docs",
        "renamed_pairs": _with(DOCS)
        + "SELECT submixture, row_idx, inputs AS prompt, targets AS response FROM docs",
        "selected_rows": _with(DOCS)
        + """SELECT submixture, row_idx, md5(inputs) AS digest FROM docs
WHERE row_idx IN (SELECT vec_id FROM embeddings)""",
        "attached_embeddings": _with(BASE)
        + f"""SELECT {GROUP}, row_idx, len(embedding) AS width, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM known""",
        "cosine_kernel": _with(BASE, totals().strip(), MEANS.strip(), TASK_KERNEL.strip())
        + "SELECT i, j, round(s, 6) + 0.0 AS s FROM k",
        "group_similarity": _with(BASE, row_kernel().strip())
        + """SELECT n.submixture, n.task_name, n.template_type, n.row_idx, round(sum(s), 6) + 0.0 AS sim_sum,
 round(sum(greatest(s, 0)), 6) + 0.0 AS positive_sum FROM k JOIN norm n ON n.g = k.g AND n.row_idx = k.i GROUP BY ALL""",
        "zero_filled_budgets": _budgeted("random") + all_budgets,
        "task_index": index,
        "task_totals": _with(BASE) + f"SELECT {TASK}, count(*) AS total FROM known GROUP BY {TASK}",
        "template_counts": _with(BASE, totals().strip()) + f"SELECT {TASK}, {', '.join(TEMPLATE_TYPES)} FROM tot",
        "task_embeddings": _with(BASE, MEANS.strip())
        + f"SELECT {TASK}, p - 1 AS dim, round(v, 6) + 0.0 AS value FROM means",
        "task_positions": _with(BASE, totals().strip()) + f"SELECT {TASK}, first_row, task_pos FROM tot",
        "task_profile": _with(BASE, totals().strip())
        + f"SELECT {TASK}, first_row, total, {', '.join(TEMPLATE_TYPES)} FROM tot",
        "feasibility": _picked("random")
        + f"SELECT sum(total)::BIGINT AS available, {ROWS} AS wanted, sum(total) >= {ROWS} AS feasible FROM tp",
        "conservation": _budgeted("random")
        + """SELECT *, task_sum = template_sum AS conserved FROM (SELECT (SELECT sum(budget) FROM bt)::BIGINT AS task_sum,
 (SELECT sum(budget) FROM tb)::BIGINT AS template_sum)""",
        "train_size": f"SELECT count(*) AS rows, {ROWS} AS wanted, count(*) = {ROWS} AS complete FROM ({mixture('random', 'random')})",
        "eval_metrics": _with(LOSSES)
        + f"SELECT epoch, round({eval_loss}, 6) AS eval_loss, round(exp({eval_loss}), 6) AS perplexity FROM losses GROUP BY epoch",
        "train_loss": _with(LOSSES)
        + "SELECT epoch, round(sum(loss) / count(*), 6) AS train_loss FROM losses GROUP BY epoch",
        "tasks_fl": tasks["fl"],
        "tasks_gc": tasks["gc"],
        "tasks_logdet": tasks["logdet"],
        "tasks_random": tasks["random"],
        "picks_by_jobs": by_jobs,
        "ordering_fl": _ordered("fl"),
        "ordering_gc": _ordered("gc"),
        "ordering_logdet": _ordered("logdet"),
        "ordering_random": _ordered("random"),
        **{f"ordering_{f}_distributed": _ordered(f) for f in ("fl", "gc", "logdet")},
        "chunked_random_ordering": _chunked("random"),
        "chunked_gc_ordering": _chunked("gc"),
        "chunked_fl_ordering": _chunked("fl"),
        "chunked_logdet_ordering": _chunked("logdet"),
        "softmax_probabilities": _with(DOCS, GAINS)
        + f"""SELECT {TASK}, round(p, 6) AS prob, round(ln(p), 6) AS log_prob FROM (
  SELECT *, w / sum(w) OVER (PARTITION BY submixture) AS p FROM (SELECT *, 1 + {taylor} AS w FROM (SELECT *, gain / 2.0 AS x FROM gains)))""",
        "integer_split": _with(DOCS, GAINS)
        + f"""SELECT {TASK}, (f + CASE WHEN row_number() OVER (PARTITION BY submixture ORDER BY task_name)
   <= 1001 - sum(f) OVER (PARTITION BY submixture) THEN 1 ELSE 0 END)::BIGINT AS budget
 FROM (SELECT *, (1001 * total) // (sum(total) OVER (PARTITION BY submixture))::BIGINT AS f FROM gains)""",
        "capped_budgets": _with(
            DOCS,
            GAINS,
            "s0 AS (SELECT submixture, task_name, greatest(total * (length(task_name) - 3) * 3 - 2, 0) AS b, total * 5 AS cap FROM gains)",
            fill("s0", "b", "cap", "task_name", "submixture"),
        )
        + f"SELECT {TASK}, cap, budget FROM bt",
        "task_budgets_random": _budgeted("random") + all_budgets,
        "task_budgets_gc": _budgeted("gc") + all_budgets,
        "task_budgets_fl": _budgeted("fl") + all_budgets,
        "task_budgets_logdet": _budgeted("logdet") + all_budgets,
        "template_budgets": _budgeted("gc") + f"SELECT {GROUP}, rows, budget FROM tb",
        "group_subsets": _budgeted("random").rstrip()
        + ","
        + row_order("random")
        + f"\nSELECT {GROUP}, rank, row_idx FROM ro JOIN tb USING ({GROUP}) WHERE rank <= budget",
        "assembled": _with(BASE) + "SELECT submixture, row_idx FROM known",
        "shuffled": _with(INST)
        + f"SELECT submixture, row_idx, row_number() OVER (ORDER BY {SHUFFLED}) - 1 AS pos FROM inst",
        "validation_rows": _with(PAIRS)
        + "SELECT submixture, row_idx, inputs AS prompt, targets AS response FROM pairs WHERE conv_id % 10 = 0",
        "mixture_random_random": mixture("random", "random"),
        **{
            f"mixture_{f1}_{f2}": mixture(f1, f2)
            for f1 in ("fl", "gc", "logdet")
            for f2 in ("fl", "gc", "logdet")
        },
        "mixture_from_loaded_ordering": mixture("gc", "fl"),
        "document_mixture_gc_fl": mixture(
            "gc", "fl", 24, 80, samples.DOCUMENT_SUBMIXTURES, DOCUMENT_BASE
        ),
        "mixture_sweep": _sweep(grid),
        "written_sweep": _written_sweep(written),
        "baseline_equal": _baseline("1.0::DOUBLE"),
        "baseline_proportional": _baseline("total::DOUBLE"),
        "embedded_prompts": _with(DOCS, EMBEDDED.strip())
        + "SELECT row_idx, bucket, round(weight::DOUBLE, 6) AS weight FROM wts",
        "concatenated_pairs": _with(PAIRS, TRAIN) + "SELECT row_idx, concat(prompt, ' ', response) AS text FROM train",
        "tokenized_pairs": _with(PAIRS, TRAIN, MASKED.strip().replace(", 1, 512)", ", 1, 64)"))
        + "SELECT row_idx, array_to_string(input_ids, ',') AS input_ids, array_to_string(prompt_ids, ',') AS prompt_ids FROM ids",
        "effective_length": _with(PAIRS, TRAIN) + lengths,
        "masked_labels": _with(PAIRS, TRAIN, MASKED.strip())
        + """SELECT row_idx, array_to_string(input_ids, ',') AS input_ids,
 array_to_string(list_transform(input_ids, lambda z: 1), ',') AS attention_mask, array_to_string(labels, ',') AS labels FROM masked""",
        "batch_plan": _with(PAIRS, TRAIN, PLAN.strip())
        + """SELECT epoch, row_idx, place, batch_id, batch_id % 2 AS device, batch_id // 2 AS step, batch_id // 8 AS "update" FROM plan""",
        "eval_batch_plan": _with(PAIRS)
        + """SELECT 0 AS epoch, row_idx, place, place // 4 AS batch_id, (place // 4) % 2 AS device, place // 8 AS step, place // 8 AS "update"
FROM (SELECT row_idx, row_number() OVER (ORDER BY row_idx) - 1 AS place FROM pairs WHERE conv_id % 10 = 0)""",
        "eval_batch_plan_sparse": _with(PAIRS)
        + """SELECT 0 AS epoch, key, place, place // 4 AS batch_id, (place // 4) % 2 AS device, place // 8 AS step, place // 8 AS "update"
FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS place FROM (
  SELECT row_idx * 7919000003 % 1000000007 AS key FROM pairs WHERE conv_id % 10 = 0))""",
        "padded_batches": _with(PAIRS, TRAIN, PLAN.strip(), MASKED.strip()) + padded,
        "padded_eval_batches": _with(PAIRS, EVAL_PLAN.strip(), MASKED.strip()) + padded,
        "resumed_plan": _with(PAIRS, TRAIN, PLAN.strip())
        + "SELECT epoch, row_idx, batch_id FROM plan WHERE epoch > 0 OR batch_id // 2 >= 3",
        "resumed_from_updates": _with(PAIRS, TRAIN, PLAN.strip())
        + """SELECT epoch, row_idx, batch_id FROM plan, (SELECT ((count(*) + 3) // 4 + 1) // 2 AS s FROM train)
WHERE epoch > 8 // s OR (epoch = 8 // s AND batch_id // 2 >= 8 % s)""",
        "sampled_rows": _with(PAIRS, TRAIN)
        + "SELECT row_idx, prompt FROM train ORDER BY md5(concat('23:', row_idx)), row_idx LIMIT 3",
        "step_counts_by_updates": _with(PAIRS, TRAIN)
        + """SELECT rows, batches, device_batches, u AS updates_per_epoch, (100 + u - 1) // u AS epochs, 100 AS updates,
 1 AS warmup_updates, 4 * 2 * 16 AS total_batch FROM (SELECT *, (device_batches + 15) // 16 AS u FROM (
 SELECT *, (batches + 1) // 2 AS device_batches FROM (SELECT count(*) AS rows, (count(*) + 3) // 4 AS batches FROM train)))""",
        "step_counts": _with(PAIRS, TRAIN)
        + f"""SELECT rows, batches, device_batches, (device_batches + 15) // 16 AS updates_per_epoch, 3 AS epochs,
 3 * ((device_batches + 15) // 16) AS updates, floor(0.01 * 3 * ({updates}))::BIGINT AS warmup_updates, 4 * 2 * 16 AS total_batch
FROM (SELECT *, (batches + 1) // 2 AS device_batches FROM (SELECT count(*) AS rows, (count(*) + 3) // 4 AS batches FROM train))""",
    }
