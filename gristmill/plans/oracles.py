"""The same results as ``catalog``, stated in SQL for DuckDB.

Each oracle takes the plain route (per-token windows, brute force over caps)
where the Spark query takes the scalable one, so the two share no method.
"""

from __future__ import annotations

import math

from gristmill.plans import catalog as Q

L = Q.LAYOUT
CHUNK, BLOCK, SHARDS = L.chunk_size, L.block_len, L.n_shards
PER_CHUNK = L.blocks_per_chunk
READERS = L.world_size * L.workers
PER_STEP = L.micro_batch * L.grad_accum * L.world_size
V, ALPHA = Q.VOCAB_SIZE, "0.1::DOUBLE"
K1, K2 = Q.TREE_KS


def _tokens(source: str) -> str:
    return (
        f"SELECT doc_id, list_append(list_transform(regexp_extract_all({source}.text, '[^ \\t\\r\\n]+'), "
        "lambda w: (3 + ('0x' || substr(md5(w), 1, 8))::BIGINT % 31997)::INTEGER), 2) AS tokens "
        f"FROM {source}"
    )


def _stream(tok: str) -> str:
    """One row per token with its position in the shard and the shard's length."""
    return (
        "SELECT shard, tok, row_number() OVER (PARTITION BY shard ORDER BY doc_id, i) - 1 AS p, "
        "count(*) OVER (PARTITION BY shard) AS t FROM "
        f"(SELECT (doc_id % {SHARDS})::INTEGER AS shard, doc_id, unnest(tokens) AS tok, "
        f"generate_subscripts(tokens, 1) AS i FROM {tok})"
    )


def _blocks(stream: str) -> str:
    return (
        f"SELECT shard, p // {BLOCK} AS unit, p % {BLOCK} AS j, tok FROM {stream} "
        f"WHERE p // {CHUNK} < (t - 1) // {CHUNK}"
    )


def _pairs(blk: str) -> str:
    return (
        "SELECT shard, unit, pos, prev, label FROM (SELECT shard, unit, j AS pos, tok AS prev, "
        f"lead(tok) OVER (PARTITION BY shard, unit ORDER BY j) AS label FROM {blk}) WHERE label IS NOT NULL"
    )


def _scored(pairs: str, base: str) -> str:
    """Positions with the losses of both count models."""
    return f"""
        SELECT p.shard, p.unit // {L.micro_batch} AS batch_no, p.unit // {PER_CHUNK} AS chunk_no,
               (p.unit % {PER_CHUNK})::INTEGER AS block_no, p.unit, p.pos, p.label,
               round(-ln((coalesce(b.n, 0) + {ALPHA}) / (coalesce(bc.total, 0) + {ALPHA} * {V})), 9) AS loss,
               round(-ln((coalesce(r.n, 0) + {ALPHA}) / (coalesce(rc.total, 0) + {ALPHA} * {V})), 9) AS ref_loss,
               round(coalesce(rc.entropy, ln({V}::DOUBLE)), 9) AS ref_entropy
        FROM {pairs} p
        LEFT JOIN {base} b ON b.prev = p.prev AND b.label = p.label
        LEFT JOIN (SELECT prev, sum(n) AS total FROM {base} GROUP BY prev) bc ON bc.prev = p.prev
        LEFT JOIN ref_n r ON r.prev = p.prev AND r.label = p.label
        LEFT JOIN ref_ctx rc ON rc.prev = p.prev"""


def _schedule(order: str) -> str:
    per_buffer = L.buffer_files * PER_CHUNK
    return f"""
    SELECT reader, gpu_rank, pass_no, name, block_no, read_pos,
           read_pos // {L.micro_batch} * {L.workers} + worker AS iter,
           (read_pos // {L.micro_batch} * {L.workers} + worker) // {L.grad_accum} AS step
    FROM (SELECT *, (pass_no * groups + file_group) * {per_buffer} - 1
                    + row_number() OVER (PARTITION BY reader, pass_no, file_group ORDER BY {order}) AS read_pos
          FROM visits)"""


_DIST = "list_distance(v.embedding::DOUBLE[], c.center)"


def _kmeans(name: str, points: str, k: int, key: str) -> dict[str, str]:
    """CTEs for the seeded start and the Lloyd steps; the last one is ``{name}_{steps}``."""
    ctes = {
        f"{name}_0": f"""
            SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS cluster, center FROM (
                SELECT embedding::DOUBLE[] AS center, min(md5('{Q.SEED}:' || {key})) AS h
                FROM {points} GROUP BY embedding::DOUBLE[]) ORDER BY h LIMIT {k}"""
    }
    for step in range(Q.KMEANS_STEPS):
        old = f"{name}_{step}"
        ctes[f"{name}_near_{step}"] = _nearest(points, old, key)
        ctes[f"{name}_means_{step}"] = f"""
            SELECT cluster, list(m ORDER BY axis) AS center FROM (
                SELECT n.cluster, axis, avg(x) AS m FROM {name}_near_{step} n
                JOIN (SELECT {key}, unnest(embedding::DOUBLE[]) AS x,
                             generate_subscripts(embedding, 1) AS axis FROM {points}) v
                ON v.{key} = n.{key} GROUP BY n.cluster, axis) GROUP BY cluster"""
        ctes[f"{name}_{step + 1}"] = f"""
            SELECT o.cluster, coalesce(m.center, o.center) AS center
            FROM {old} o LEFT JOIN {name}_means_{step} m USING (cluster)"""
    return ctes


def _nearest(points: str, centers: str, key: str) -> str:
    return f"""
        SELECT {key}, cluster, distance FROM (
            SELECT v.{key}, c.cluster, {_DIST} AS distance,
                   row_number() OVER (PARTITION BY v.{key} ORDER BY {_DIST}, c.cluster) AS r
            FROM {points} v CROSS JOIN {centers} c) WHERE r = 1"""


STEPS = Q.KMEANS_STEPS

CTES: dict[str, str] = {
    "tok": _tokens("documents"),
    "cnt": "SELECT doc_id, len(tokens)::BIGINT AS n_tokens FROM tok",
    "stream": _stream("tok"),
    "blk": _blocks("stream"),
    "pairs": _pairs("blk"),
    "good": "SELECT d.* FROM documents d SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) g USING (doc_id)",
    "good_tok": _tokens("good"),
    "good_cnt": "SELECT doc_id, len(tokens)::BIGINT AS n_tokens FROM good_tok",
    "base_n": f"SELECT prev AS prev, label AS label, count(*) AS n FROM pairs GROUP BY ALL",
    "ref_n": f"""
        SELECT prev AS prev, label AS label, count(*) AS n FROM (
            SELECT tok AS prev, lead(tok) OVER (PARTITION BY doc_id ORDER BY i) AS label FROM (
                SELECT doc_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS i FROM good_tok))
        WHERE label IS NOT NULL GROUP BY ALL""",
    "ref_tot": "SELECT prev, sum(n) AS total, count(*) AS seen FROM ref_n GROUP BY prev",
    "ref_ctx": f"""
        SELECT prev, any_value(total)::BIGINT AS total,
               -sum(q * ln(q)) - ({V} - any_value(seen)) * any_value(q0) * ln(any_value(q0)) AS entropy
        FROM (SELECT r.prev, t.total, t.seen, (r.n + {ALPHA}) / (t.total + {ALPHA} * {V}) AS q,
                     {ALPHA} / (t.total + {ALPHA} * {V}) AS q0
              FROM ref_n r JOIN ref_tot t USING (prev)) GROUP BY prev""",
    "scores": f"SELECT *, round(loss - ref_loss, 9) AS excess FROM ({_scored('pairs', 'base_n')})",
    # The base model as its own reference.
    "base_tot": "SELECT prev, sum(n) AS total, count(*) AS seen FROM base_n GROUP BY prev",
    "own_ctx": f"""
        SELECT prev, any_value(total)::BIGINT AS total,
               -sum(q * ln(q)) - ({V} - any_value(seen)) * any_value(q0) * ln(any_value(q0)) AS entropy
        FROM (SELECT b.prev, t.total, t.seen, (b.n + {ALPHA}) / (t.total + {ALPHA} * {V}) AS q,
                     {ALPHA} / (t.total + {ALPHA} * {V}) AS q0
              FROM base_n b JOIN base_tot t USING (prev)) GROUP BY prev""",
    "own_scores": f"""
        SELECT p.shard, p.unit // {PER_CHUNK} AS chunk_no, (p.unit % {PER_CHUNK})::INTEGER AS block_no, p.unit, p.pos,
               round(-ln((b.n + {ALPHA}) / (c.total + {ALPHA} * {V})), 9) AS loss, loss AS ref_loss,
               round(c.entropy, 9) AS ref_entropy
        FROM pairs p JOIN base_n b ON b.prev = p.prev AND b.label = p.label JOIN own_ctx c ON c.prev = p.prev""",
    "manifest": f"""
        SELECT shard, chunk_no, {CHUNK}::BIGINT AS chunk_size,
               printf('shard-%05d_%010d.bin', shard, chunk_no) AS name
        FROM (SELECT shard, unnest(range((t - 1) // {CHUNK})) AS chunk_no FROM (
            SELECT doc_id % {SHARDS} AS shard, sum(n_tokens)::BIGINT AS t FROM cnt GROUP BY ALL))""",
    "ranked": f"""
        SELECT name, row_number() OVER (ORDER BY md5('{Q.SEED}:' || name)) - 1 AS fr, count(*) OVER () AS nf
        FROM manifest""",
    "assigned": f"""
        SELECT name, fr < nf // {READERS} * {READERS} AS kept, (fr % {READERS})::INTEGER AS reader,
               fr // {READERS} AS slot, (fr % {READERS} // {L.workers})::INTEGER AS gpu_rank,
               (fr % {READERS} % {L.workers})::INTEGER AS worker, nf // {READERS} AS files_each
        FROM ranked""",
    "readable": f"""
        SELECT *, slot // {L.buffer_files} AS file_group, files_each // {L.buffer_files} AS groups
        FROM assigned WHERE kept AND slot < files_each // {L.buffer_files} * {L.buffer_files}""",
    "visits": f"""
        SELECT r.*, p.pass_no, b.block_no FROM readable r,
            (SELECT unnest(range(2))::INTEGER AS pass_no) p,
            (SELECT unnest(range({PER_CHUNK}))::INTEGER AS block_no) b""",
    "schedule": _schedule(
        f"md5('{Q.SEED}:' || reader || ':' || pass_no || ':' || file_group || ':' || name || ':' || block_no)"
    ),
    "headers": f"""
        SELECT name AS path, CASE WHEN f = 0 THEN 'XXXXXXX' ELSE 'LITPKDS' END AS magic,
               CASE WHEN f = 4 THEN 2 ELSE 1 END AS version, CASE WHEN f = 1 THEN 9 ELSE 8 END AS code,
               {CHUNK} + (f = 2)::INTEGER AS chunk_size,
               24 + ({CHUNK} + (f = 2)::INTEGER) * 2 - (f = 3)::INTEGER AS length
        FROM (SELECT name, CASE WHEN chunk_no > 0
                  THEN ('0x' || substr(md5('{Q.SEED}:fault:' || name), 1, 2))::BIGINT % 12 ELSE 11 END AS f
              FROM manifest)""",
    "audited": """
        SELECT *, CASE WHEN magic <> 'LITPKDS' THEN 'bad_magic' WHEN code <> 8 THEN 'unknown_dtype'
                       WHEN chunk_size <> (SELECT arg_min(chunk_size, path) FROM headers) THEN 'header_differs'
                       WHEN length <> 24 + chunk_size * 2 THEN 'bad_size'
                       WHEN version <> 1 THEN 'bad_version' ELSE 'ok' END AS status
        FROM headers""",
    **_kmeans("km", "embeddings", K1, "vec_id"),
    "leaf": _nearest("embeddings", f"km_{STEPS}", "vec_id"),
    "upper": f"SELECT cluster AS id, center AS embedding FROM km_{STEPS}",
    **_kmeans("up", "upper", K2, "id"),
    "parent": _nearest("upper", f"up_{STEPS}", "id"),
    "paths": """
        SELECT l.vec_id, l.cluster AS c1, p.cluster AS c2, l.distance
        FROM leaf l JOIN parent p ON p.id = l.cluster""",
    # Balanced caps by brute force over every integer cap.
    "top_size": "SELECT c2, count(*) AS size FROM paths GROUP BY c2",
    "top_cap": """
        SELECT cap FROM (SELECT unnest(range((SELECT max(size) FROM top_size) + 1)) AS cap) g, top_size
        GROUP BY cap ORDER BY abs((SELECT count(*) FROM paths) // 2 - sum(least(cap, size))), cap LIMIT 1""",
    "top_quota": "SELECT c2, least(size, (SELECT cap FROM top_cap)) AS budget FROM top_size",
    "leaf_size": "SELECT c1, c2, count(*) AS size FROM paths GROUP BY c1, c2",
    "leaf_cap": """
        SELECT c2, arg_min(cap, abs(budget - placed) * 1000000000 + cap) AS cap FROM (
            SELECT s.c2, g.cap, any_value(q.budget) AS budget, sum(least(g.cap, s.size)) AS placed
            FROM leaf_size s JOIN top_quota q USING (c2)
            CROSS JOIN (SELECT unnest(range((SELECT max(size) FROM leaf_size) + 1)) AS cap) g
            GROUP BY s.c2, g.cap) GROUP BY c2""",
    "quotas": "SELECT c1, c2, size, least(size, cap)::BIGINT AS quota FROM leaf_size JOIN leaf_cap USING (c2)",
    "sampled": f"""
        SELECT vec_id, c1, c2 FROM (
            SELECT p.*, q.quota, row_number() OVER (PARTITION BY c1, c2
                ORDER BY md5('{Q.SEED}:' || vec_id), vec_id) AS r
            FROM paths p JOIN quotas q USING (c1, c2)) WHERE r <= quota""",
    # The hybrid job: the same blocks and scores inside the sampled subset.
    "hyb_tok": "SELECT t.* FROM tok t SEMI JOIN sampled s ON s.vec_id = t.doc_id",
    "hyb_stream": _stream("hyb_tok"),
    "hyb_blk": _blocks("hyb_stream"),
    "hyb_pairs": _pairs("hyb_blk"),
    "hyb_base": f"SELECT prev AS prev, label AS label, count(*) AS n FROM hyb_pairs GROUP BY ALL",
    "hyb_scores": f"SELECT *, round(loss - ref_loss, 9) AS excess FROM ({_scored('hyb_pairs', 'hyb_base')})",
    "first_near": _nearest("embeddings", "km_0", "vec_id"),
    "log": f"""
        SELECT user_id % {Q.RUNS} AS run, event_id AS step, value / 100.0::DOUBLE AS loss, epoch_us(ts) AS us,
               (512 + floor(value))::BIGINT AS batch_tokens,
               CASE WHEN event_type = 'error' THEN value ELSE 0.0::DOUBLE END AS eval_seconds
        FROM events""",
    "rlog": """
        SELECT *, row_number() OVER w - 1 AS rnk, (us - min(us) OVER (PARTITION BY run)) / 1e6::DOUBLE AS elapsed,
               row_number() OVER w * 16 AS samples,
               sum(batch_tokens) OVER w AS lengths, sum(eval_seconds) OVER w AS val
        FROM log WINDOW w AS (PARTITION BY run ORDER BY step)""",
    "back": """
        SELECT *, nullif(elapsed - lag(elapsed, 100) OVER w, 0) AS ds, samples - lag(samples, 100) OVER w AS dn,
               lengths - lag(lengths, 100) OVER w AS dt
        FROM rlog WINDOW w AS (PARTITION BY run ORDER BY step)""",
    "samples": """
        SELECT d.source AS dataset, d.lang AS type, l.quality AS score,
               CASE WHEN l.quality IS NULL THEN 'empty' WHEN l.toxic = 1 THEN 'timeout' ELSE 'ok' END AS status
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "acc": """
        SELECT dataset, type, count(*) AS num_samples, count(score) AS num_scores,
               count(*) FILTER (status = 'timeout') AS timeout_samples,
               count(*) FILTER (status = 'empty') AS empty_samples,
               round(avg(score::DOUBLE) * 100, 1) AS acc, grouping(type) > 0 AS whole_dataset
        FROM samples GROUP BY GROUPING SETS ((dataset), (dataset, type))""",
    "res": "SELECT dataset AS model, type AS task, acc FROM acc WHERE NOT whole_dataset",
}


def _with(body: str) -> str:
    """``body`` behind all named tables; the unused ones cost nothing."""
    listed = ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items())
    return f"WITH {listed}\n{body}"


IDS = "md5(array_to_string(list(tok ORDER BY {0}), ' '))"

_SUMMARY = """
    SELECT shard, batch_no, count(*) AS n_positions, count(*) FILTER (sel) AS n_selected,
           (sum(unit * 128 + pos) FILTER (sel))::BIGINT AS place_sum,
           round(sum(loss) FILTER (sel), 4) AS loss_sum
    FROM ({0}) GROUP BY shard, batch_no"""


def _top(score: str, ratio: float, batch: str = "shard, batch_no") -> str:
    return (
        f"rank() OVER (PARTITION BY {batch} ORDER BY {score} DESC) <= "
        f"greatest(1, ceil(count(*) OVER (PARTITION BY {batch}) * {ratio}::DOUBLE))"
    )


_EXCESS = f"SELECT *, {_top('excess', 0.6)} AS sel FROM scores"
_SELF = f"SELECT *, {_top('-ref_loss', 0.7)} AND {_top('-ref_entropy', 0.7)} AS sel FROM scores"
_HYBRID = f"SELECT *, {_top('-ref_loss', 0.7)} AND {_top('-ref_entropy', 0.7)} AS sel FROM hyb_scores"
_HIGH = f"SELECT *, {_top('ref_loss', 0.6)} AND {_top('ref_entropy', 0.6)} AS sel FROM scores"


def _as_read(scores: str, one: str, other: str, ratio: float) -> str:
    """Selection in the batches of the reading schedule."""
    batch = "r.gpu_rank, r.iter"
    return f"""
        SELECT gpu_rank, iter, step, count(*) AS n_positions, count(*) FILTER (sel) AS n_selected,
               (sum(unit * 128 + pos) FILTER (sel))::BIGINT AS place_sum, round(sum(loss) FILTER (sel), 4) AS loss_sum
        FROM (SELECT r.gpu_rank, r.iter, r.step, s.unit, s.pos, s.loss,
                     {_top(f"{one}s.ref_loss", ratio, batch)} AND {_top(f"{other}s.ref_entropy", ratio, batch)} AS sel
              FROM {scores} s JOIN schedule r
              ON r.name = printf('shard-%05d_%010d.bin', s.shard, s.chunk_no) AND r.block_no = s.block_no)
        GROUP BY ALL"""


_BATCHES = f"""
    SELECT shard, batch_no, coalesce(sum(loss) FILTER (sel), 0) AS loss_sum,
           count(*) FILTER (sel) AS n_selected, count(*) AS n_positions FROM ({_EXCESS}) GROUP BY ALL"""


def _accounting(files: str) -> str:
    return f"""
    SELECT *, total_files - usable_files AS dropped_files, usable_files * blocks_per_file AS total_blocks,
           usable_files * chunk_size AS total_raw_tokens,
           usable_files * blocks_per_file * {L.block_size} AS total_supervised_tokens,
           {PER_STEP * L.block_size}::BIGINT AS tokens_per_step,
           usable_files * blocks_per_file // {PER_STEP} AS max_steps_nominal,
           usable_files * blocks_per_file % {PER_STEP} AS leftover_blocks,
           reachable_files * blocks_per_file // {PER_STEP} AS max_steps_reachable
    FROM (SELECT total_files, chunk_size, total_files // {READERS} * {READERS} AS usable_files,
                 chunk_size // {BLOCK} AS blocks_per_file,
                 total_files // {READERS} // {L.buffer_files} * {L.buffer_files} * {READERS} AS reachable_files
          FROM (SELECT count(*) AS total_files, {CHUNK}::BIGINT AS chunk_size FROM {files}))"""


def _budget(planned: str) -> str:
    return f"""
    SELECT s AS pass_steps, ({planned})::BIGINT AS planned_steps,
           CASE WHEN s < ({planned}) THEN 'repeats_data' WHEN s > ({planned}) THEN 'leaves_data'
                ELSE 'exact' END AS verdict,
           round(CASE WHEN s > 0 THEN abs(({planned}) - s) / s::DOUBLE * 100 END, 6) AS percent
    FROM (SELECT count(*) // {READERS} * {READERS} * {PER_CHUNK} // {PER_STEP} AS s FROM manifest)"""


_WARM, _FLAT = Q.WARMUP, Q.WARMUP + Q.STABLE
_DECAY = Q.MAX_STEPS - _FLAT
_PEAK, _FLOOR = Q.PEAK_LR * 1e6, Q.FLOOR_LR * 1e6
_SEQ_FLOPS = 3 * (2 * 1_100_048_384 * 2048 + 4 * 22 * 2048 * 2048**2) + 2 * (4 * 22 * 2048 * 2048**2)


def _mix_draw() -> str:
    u = f"('0x' || substr(md5('{Q.SEED}:draw:' || draw_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    cases, edge = "", 0.0
    names = list(Q.MIX)
    for name in names[:-1]:
        edge += Q.MIX[name]
        cases += f" WHEN {u} < {edge / math.fsum(Q.MIX.values())!r}::DOUBLE THEN '{name}'"
    return f"CASE{cases} ELSE '{names[-1]}' END"


_LOGITS = """
SELECT vec_id, round(norm - e[vec_id % len(e) + 1], 6) AS loss,
       round(norm - list_sum(list_transform(e, lambda x: x * exp(x - norm))), 6) AS entropy
FROM (SELECT vec_id, e, ln(list_sum(list_transform(e, lambda x: exp(x)))) AS norm
      FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))
"""


def oracle_sql() -> dict[str, str]:
    shard_rows = f"SELECT doc_id, (doc_id % {SHARDS})::INTEGER AS shard FROM documents"
    out = {
        "corpus_profile": """
            SELECT lang, source, count(*) AS docs, sum(length(text))::BIGINT AS chars, max(length(text)) AS longest
            FROM documents GROUP BY ALL""",
        "tokenize_ids": _with(
            "SELECT doc_id, len(tokens)::BIGINT AS n_tokens, md5(array_to_string(tokens, ' ')) AS ids_md5 FROM tok"
        ),
        "doc_token_counts": _with(
            """SELECT lang, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens, max(n_tokens) AS longest,
                      min(n_tokens) AS shortest FROM documents JOIN cnt USING (doc_id) GROUP BY lang"""
        ),
        "shard_assign": shard_rows,
        "stream_offsets": _with(
            f"""SELECT doc_id, shard, (upto - n_tokens)::BIGINT AS start_pos, upto::BIGINT AS end_pos,
                       shard_tokens::BIGINT AS shard_tokens
                FROM (SELECT doc_id, (doc_id % {SHARDS})::INTEGER AS shard, n_tokens,
                             sum(n_tokens) OVER (PARTITION BY doc_id % {SHARDS} ORDER BY doc_id) AS upto,
                             sum(n_tokens) OVER (PARTITION BY doc_id % {SHARDS}) AS shard_tokens FROM cnt)"""
        ),
        "stream_offsets_deep": _with(
            f"""SELECT doc_id, shard, (upto - n_tokens)::BIGINT AS start_pos, upto::BIGINT AS end_pos,
                       shard_tokens::BIGINT AS shard_tokens
                FROM (SELECT doc_id, (doc_id % {SHARDS})::INTEGER AS shard, n_tokens,
                             sum(n_tokens) OVER (PARTITION BY doc_id % {SHARDS} ORDER BY doc_id) AS upto,
                             sum(n_tokens) OVER (PARTITION BY doc_id % {SHARDS}) AS shard_tokens FROM cnt)"""
        ),
        "packed_chunks": _with(
            f"""SELECT shard, p // {CHUNK} AS chunk_no, count(*)::INTEGER AS n_tokens, {IDS.format('p')} AS ids_md5
                FROM stream WHERE p // {CHUNK} < (t - 1) // {CHUNK} GROUP BY ALL"""
        ),
        "packed_padded": _with(
            f"""SELECT shard, chunk_no, count(*)::INTEGER AS n_tokens, {IDS.format('p')} AS ids_md5 FROM (
                    SELECT shard, p // {CHUNK} AS chunk_no, p, tok FROM stream
                    UNION ALL
                    SELECT s.shard, coalesce((t - 1) // {CHUNK}, 0) AS chunk_no,
                           unnest(range(coalesce(t, 0), (coalesce((t - 1) // {CHUNK}, 0) + 1) * {CHUNK})) AS p, 1 AS tok
                    FROM (SELECT unnest(range({SHARDS}))::INTEGER AS shard) s
                    LEFT JOIN (SELECT shard, count(*) AS t FROM stream GROUP BY shard) x USING (shard))
                GROUP BY ALL"""
        ),
        "packed_blocks": _with(
            f"""SELECT shard, unit // {PER_CHUNK} AS chunk_no, (unit % {PER_CHUNK})::INTEGER AS block_no,
                       {IDS.format('j')} AS ids_md5 FROM blk GROUP BY shard, unit"""
        ),
        "packed_blocks_padded": _with(
            f"""SELECT shard, p // {CHUNK} AS chunk_no, (p % {CHUNK} // {BLOCK})::INTEGER AS block_no,
                       {IDS.format('p')} AS ids_md5 FROM (
                    SELECT shard, p, tok FROM stream
                    UNION ALL
                    SELECT s.shard,
                           unnest(range(coalesce(t, 0), (coalesce((t - 1) // {CHUNK}, 0) + 1) * {CHUNK})) AS p, 1 AS tok
                    FROM (SELECT unnest(range({SHARDS}))::INTEGER AS shard) s
                    LEFT JOIN (SELECT shard, count(*) AS t FROM stream GROUP BY shard) x USING (shard))
                GROUP BY ALL"""
        ),
        "packed_dropped": _with(
            f"""SELECT shard, count(*) AS tokens, count(*) - (count(*) - 1) // {CHUNK} * {CHUNK} AS dropped
                FROM stream GROUP BY shard"""
        ),
        "next_token_pairs": _with(
            f"""SELECT shard, unit // {PER_CHUNK} AS chunk_no, (unit % {PER_CHUNK})::INTEGER AS block_no,
                       count(*) AS pairs, sum((pos + 1) * (prev * 3 + label))::BIGINT AS checksum
                FROM pairs GROUP BY shard, unit"""
        ),
        "roundtrip_check": _with(
            f"""SELECT shard, count(*) AS docs, count(*) FILTER (upto <= (t - 1) // {CHUNK} * {CHUNK}) AS rebuilt,
                       0::BIGINT AS mismatches, count(*) FILTER (upto > (t - 1) // {CHUNK} * {CHUNK}) AS cut
                FROM (SELECT (doc_id % {SHARDS})::INTEGER AS shard,
                             sum(n_tokens) OVER (PARTITION BY doc_id % {SHARDS} ORDER BY doc_id) AS upto,
                             sum(n_tokens) OVER (PARTITION BY doc_id % {SHARDS}) AS t FROM cnt) GROUP BY shard"""
        ),
        "detokenize_plugin": _with(
            "SELECT doc_id, md5(array_to_string(tokens[:-2], ' ')) AS text_md5 FROM tok"
        ),
        "embed_plugin": """
            SELECT doc_id, len(string_split(text, ' '))::DOUBLE AS v0, length(text)::DOUBLE AS v1 FROM documents""",
        "bin_audit": _with(
            f"""SELECT 'ok' AS status, true AS usable, 1::BIGINT AS version, 8 AS dtype_code,
                       {CHUNK}::BIGINT AS chunk_size, count(*) AS files,
                       (count(*) * {24 + 2 * CHUNK})::BIGINT AS bytes FROM manifest"""
        ),
        "reader_assignment": _with("SELECT name, kept, reader, slot, gpu_rank, worker FROM assigned"),
        "read_schedule": _with("SELECT * FROM schedule"),
        "read_schedule_natural": _with(_schedule("slot, block_no")),
        "read_coverage": _with(
            f"""SELECT status, count(*) AS files, count(*) * {PER_CHUNK} AS blocks,
                       count(*) * {PER_CHUNK} * {L.block_size} AS supervised_tokens
                FROM (SELECT CASE WHEN NOT kept THEN 'dropped'
                                  WHEN files_each < {L.buffer_files} THEN 'too_few_files'
                                  WHEN slot < files_each // {L.buffer_files} * {L.buffer_files} THEN 'read'
                                  ELSE 'unread_tail' END AS status FROM assigned) GROUP BY status"""
        ),
        "shard_audit": _with(
            """SELECT status, status IN ('ok', 'bad_version') AS usable, count(*) AS files,
                      sum(length)::BIGINT AS bytes FROM audited GROUP BY status"""
        ),
        "token_accounting": _with(_accounting("manifest")),
        "token_accounting_usable": _with(_accounting("audited WHERE status IN ('ok', 'bad_version')")),
        "budget_compare": _with(f"{_budget('s * 163 // 100')} UNION ALL {_budget('7')}"),
        "kmeans_assign": _with(
            "SELECT vec_id, cluster, round(distance, 6) AS distance FROM first_near"
        ),
        "kmeans_lloyd": _with("SELECT vec_id, cluster FROM leaf"),
        "kmeans_routed": _with("SELECT vec_id, cluster FROM leaf"),
        "kmeans_bounded": _with("SELECT vec_id, cluster FROM leaf"),
        "cluster_tree": _with("SELECT vec_id, c1, c2 FROM paths"),
        "cluster_profile": _with(
            """SELECT level, cluster, docs, tokens,
                      round(docs / sum(docs) OVER (PARTITION BY level), 6) AS doc_share,
                      round(tokens / sum(tokens) OVER (PARTITION BY level), 6) AS token_share,
                      round(docs / avg(docs) OVER (PARTITION BY level), 6) AS imbalance
               FROM (SELECT level, cluster, count(*) AS docs, coalesce(sum(n_tokens), 0)::BIGINT AS tokens FROM (
                        SELECT vec_id, 1 AS level, c1 AS cluster FROM paths
                        UNION ALL SELECT vec_id, 2, c2 FROM paths) x
                     LEFT JOIN cnt ON cnt.doc_id = x.vec_id GROUP BY level, cluster)"""
        ),
        "balanced_allocation": _with("SELECT c1, c2, size, quota FROM quotas"),
        "hier_balanced_sample": _with("SELECT vec_id, c1, c2 FROM sampled"),
        "hier_nearest_sample": _with(
            f"""SELECT vec_id, c1, c2 FROM (
                    SELECT p.*, q.quota, row_number() OVER (PARTITION BY c1, c2 ORDER BY distance,
                        md5('{Q.SEED}:' || vec_id), vec_id) AS r
                    FROM paths p JOIN quotas q USING (c1, c2)) WHERE r <= quota"""
        ),
        "random_budget_subset": _with(
            f"""SELECT doc_id, n_tokens FROM (
                    SELECT *, sum(n_tokens) OVER (ORDER BY md5('{Q.SEED}:' || doc_id)) AS upto,
                           sum(n_tokens) OVER () AS t FROM cnt) WHERE upto <= t // 2"""
        ),
        "repeat_subset": _with(
            f"""SELECT doc_id, n_tokens, pass_no FROM (
                    SELECT *, unnest(range((b // t + (upto <= b % t)::INTEGER)::BIGINT)) AS pass_no FROM (
                        SELECT *, t * 163 // 100 AS b FROM (
                            SELECT doc_id, n_tokens, sum(n_tokens) OVER (ORDER BY md5('{Q.SEED}:' || doc_id)) AS upto,
                                   sum(n_tokens) OVER () AS t FROM good_cnt)))"""
        ),
        "mixture_draws": f"""
            WITH draws AS (SELECT draw_id, {_mix_draw()} AS lang
                           FROM (SELECT unnest(range(2 * (SELECT count(*) FROM documents))) AS draw_id)),
            numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY draw_id) - 1 AS k FROM draws),
            items AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
                          ORDER BY md5('{Q.SEED}:' || doc_id)) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS n
                      FROM documents)
            SELECT d.draw_id, d.lang, i.doc_id, d.k // i.n AS lap
            FROM numbered d JOIN items i ON i.lang = d.lang AND i.slot = d.k % i.n""",
        "token_scores": _with(
            """SELECT shard, batch_no, chunk_no, block_no, pos::INTEGER AS pos, label, round(loss, 6) AS loss,
                      round(ref_loss, 6) AS ref_loss, round(ref_entropy, 6) AS ref_entropy,
                      round(excess, 6) AS excess FROM scores"""
        ),
        "ref_entropy": _with("SELECT prev, total, round(entropy, 6) AS entropy FROM ref_ctx"),
        "top_ratio_mask": _with(_SUMMARY.format(f"SELECT *, {_top('loss', 0.07)} AS sel FROM scores")),
        "top_ratio_whole": _with(
            _SUMMARY.format(f"SELECT *, {_top('loss', 0.07, '1')} AND {_top('-ref_entropy', 0.7, '1')} AS sel FROM scores")
        ),
        "select_excess_loss": _with(_SUMMARY.format(_EXCESS)),
        "select_self_reference": _with(_SUMMARY.format(_SELF)),
        "select_high_high": _with(_SUMMARY.format(_HIGH)),
        "select_plugin_scores": _with(
            _SUMMARY.format(
                f"""SELECT *, {_top('-ref_loss', 0.7)} AND {_top('-ref_entropy', 0.7)} AS sel FROM (
                    SELECT shard, unit // {L.micro_batch} AS batch_no, unit, pos, (label % 97)::DOUBLE AS loss,
                           (label % 89)::DOUBLE AS ref_loss, (prev % 83)::DOUBLE AS ref_entropy FROM pairs)"""
            )
        ),
        "masked_loss": _with(
            f"""SELECT shard, batch_no, round(loss_sum, 4) AS loss_sum, n_selected, n_positions,
                       round(loss_sum / greatest(n_selected, 1), 6) AS loss FROM ({_BATCHES})"""
        ),
        "interval_loss": _with(
            f"""SELECT batch_no // {L.grad_accum} // 10 AS interval_no, round(sum(loss_sum), 4) AS loss_sum,
                       sum(n_selected)::BIGINT AS n_selected, sum(n_positions)::BIGINT AS n_positions,
                       round(sum(loss_sum) / greatest(sum(n_selected), 1), 6) AS loss,
                       round(sum(n_selected) / sum(n_positions), 6) AS selected_ratio
                FROM ({_BATCHES}) GROUP BY ALL"""
        ),
        "masked_ce_mean": _with(
            """SELECT shard, round(avg(loss) FILTER (label <> 2), 6) AS mean_kept,
                      round(sum(loss) FILTER (label <> 2) / count(*), 6) AS mean_all,
                      count(*) FILTER (label <> 2) AS n_kept, count(*) AS n_all FROM scores GROUP BY shard"""
        ),
        "kmeans_ml": """
            SELECT count(*) AS n_vectors, count(*) AS n_assigned, count(*) AS n_nearest, true AS no_worse
            FROM embeddings""",
        "select_stored_read_order": _with(_as_read("own_scores", "-", "-", 0.7)),
        "select_stored_high_high": _with(_as_read("scores", "", "", 0.6)),
        "logit_losses": _LOGITS,
        "logit_slices": _LOGITS,
        "run_log_files": _with(
            """SELECT 'run' || run AS run, count(*) AS steps, count(*) FILTER ((rnk + 1) % 7 <> 0) AS on_schedule,
                      (sum(batch_tokens) * 1000)::BIGINT AS tok_s, round(sum(round(loss, 4)), 2) AS loss
               FROM rlog GROUP BY run"""
        ),
        "eval_files": _with(
            """SELECT w.dataset, w.num_samples, w.num_scores, w.timeout_samples, w.empty_samples, w.acc,
                      t.type, t.acc AS type_acc
               FROM acc w JOIN acc t ON t.dataset = w.dataset AND NOT t.whole_dataset WHERE w.whole_dataset"""
        ),
        "hybrid_select": _with(_SUMMARY.format(_HYBRID)),
        "read_order_loss": _with(
            f"""SELECT step // 10 AS interval_no, round(sum(loss) FILTER (sel), 4) AS loss_sum,
                       count(*) FILTER (sel) AS n_selected, count(*) AS n_positions,
                       round(sum(loss) FILTER (sel) / count(*) FILTER (sel), 6) AS loss,
                       round(count(*) FILTER (sel) / count(*), 6) AS selected_ratio
                FROM (SELECT r.step, s.loss,
                             {_top('s.excess', 0.6, 'r.gpu_rank, r.iter')} AS sel
                      FROM scores s JOIN schedule r
                      ON r.name = printf('shard-%05d_%010d.bin', s.shard, s.chunk_no) AND r.block_no = s.block_no)
                GROUP BY ALL"""
        ),
        "rolling_loss": _with(
            """SELECT run, step, round(m, 6) AS train_loss, round(exp(m), 6) AS train_ppl FROM (
                   SELECT run, step, avg(loss) OVER (PARTITION BY run ORDER BY step
                       ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS m FROM log)"""
        ),
        "rolling_throughput": _with(
            f"""SELECT run, step, round(100 / ds * {L.world_size}, 6) AS batches_per_sec,
                       round(dn / ds * {L.world_size}, 6) AS samples_per_sec,
                       round(dt / ds * {L.world_size}, 6) AS tokens_per_sec,
                       round(dn / ds * (dt / 100) * {L.world_size}, 6) AS tokens_per_sec_by_length,
                       round(100 / ds, 6) AS device_batches_per_sec, round(dn / ds, 6) AS device_samples_per_sec,
                       round(dt / ds, 6) AS device_tokens_per_sec FROM back"""
        ),
        "interval_throughput": _with(
            f"""SELECT run, step, (dt * {L.world_size})::BIGINT AS tokens, round(ds, 6) AS seconds,
                       round(dt * {L.world_size} / nullif(ds, 0), 6) AS tok_s
                FROM (SELECT run, step, elapsed - coalesce(lag(elapsed) OVER w, 0) AS ds,
                             lengths - coalesce(lag(lengths) OVER w, 0) AS dt
                      FROM rlog WHERE (rnk + 1) % 10 = 0 WINDOW w AS (PARTITION BY run ORDER BY step))"""
        ),
        "lr_schedule": _with(
            f"""SELECT run, n AS step,
                       CASE WHEN n < {_WARM} THEN 'warmup' WHEN n < {_FLAT} THEN 'stable' ELSE 'decay' END AS phase,
                       round(CASE WHEN n < {_WARM} THEN {_PEAK}::DOUBLE * n / {_WARM}
                                  WHEN n < {_FLAT} THEN {_PEAK}::DOUBLE
                                  ELSE {_FLOOR}::DOUBLE + 0.5::DOUBLE * (1 + cos(pi() * (n - {_FLAT}) / {_DECAY}))
                                       * ({_PEAK}::DOUBLE - {_FLOOR}::DOUBLE) END, 6) AS micro_lr
                FROM (SELECT run, rnk + 1 AS n FROM rlog)"""
        ),
        "step_merge": """
            SELECT event_id // 7 AS step, arg_max(value, event_id) FILTER (event_type = 'click') AS click,
                   arg_max(value, event_id) FILTER (event_type = 'error') AS error,
                   arg_max(value, event_id) FILTER (event_type = 'purchase') AS purchase,
                   arg_max(value, event_id) FILTER (event_type = 'signup') AS signup,
                   arg_max(value, event_id) FILTER (event_type = 'view') AS "view"
            FROM events GROUP BY 1""",
        "elapsed_time": _with(
            """SELECT run, step, round(elapsed / 3600, 6) AS time_train, round(val / 3600, 6) AS time_val,
                      round((elapsed + val) / 3600, 6) AS time_total FROM rlog"""
        ),
        "flops_mfu": _with(
            f"""SELECT run, step, round(f / 1e12, 4) AS device_tflops, round(f * {L.world_size} / 1e12, 4) AS tflops,
                       round(f / 312e12, 4) AS mfu
                FROM (SELECT run, step, {_SEQ_FLOPS}::DOUBLE * dt / ds AS f FROM back)"""
        ),
        "run_compare": _with(
            """SELECT step_group, round(a.m, 9) AS left_value, round(b.m, 9) AS right_value, round(a.m - b.m, 9) AS difference
               FROM (SELECT step // 16 AS step_group, avg(loss) AS m FROM log WHERE run = 0 GROUP BY 1) a
               FULL JOIN (SELECT step // 16 AS step_group, avg(loss) AS m FROM log WHERE run = 1 GROUP BY 1) b USING (step_group)"""
        ),
        "run_log_lines": _with(
            f"""SELECT 'run' || run AS run, rnk + 1 AS step, {Q.MAX_STEPS}::BIGINT AS max_steps,
                       round(loss, 4) AS loss, CASE WHEN run % 2 = 1 THEN 0.625::DOUBLE END AS selected,
                       {Q.PEAK_LR}::DOUBLE AS lr, 0.5::DOUBLE AS grad_norm, batch_tokens * 1000 AS tok_s FROM rlog"""
        ),
        "checkpoint_events": _with(
            """SELECT DISTINCT 'run' || run AS run, '/runs/a' AS folder, rnk + 1 AS step
               FROM (SELECT *, max(rnk) OVER (PARTITION BY run) AS last FROM rlog)
               WHERE (rnk + 1) % 500 = 0 OR rnk = last"""
        ),
        "compute_ledger": _with(
            f"""SELECT run, u AS unique_tokens, fwd AS forward_tokens, round(fwd * kept)::BIGINT AS backward_tokens,
                       round(fwd / u, 6) AS passes
                FROM (SELECT run, u::BIGINT AS u, s * {PER_STEP * L.block_size} AS fwd, kept FROM (
                    SELECT 'full' AS run, (SELECT sum(n_tokens) FROM cnt) AS u, 1.0::DOUBLE AS kept
                    UNION ALL SELECT 'repeated', (SELECT sum(n_tokens) FROM good_cnt), 1.0
                    UNION ALL SELECT 'selected', (SELECT sum(n_tokens) FROM cnt),
                        (SELECT sum(n_selected) / sum(n_positions) FROM ({_BATCHES}))),
                    (SELECT count(*) // {READERS} * {READERS} * {PER_CHUNK} // {PER_STEP} AS s FROM manifest))"""
        ),
        "eval_accuracy": _with("SELECT * FROM acc"),
        "eval_report": _with(
            """SELECT w.dataset, w.num_samples, w.num_scores, w.acc, t.types, t.best_type
               FROM acc w JOIN (SELECT dataset, count(*)::INTEGER AS types, max(acc) AS best_type
                                FROM acc WHERE NOT whole_dataset GROUP BY dataset) t USING (dataset)
               WHERE w.whole_dataset"""
        ),
        "leaderboard": _with(
            """SELECT *, round((de + en + es + fr) / 4, 1) AS average FROM (
                   SELECT model, any_value(acc) FILTER (task = 'de') AS de, any_value(acc) FILTER (task = 'en') AS en,
                          any_value(acc) FILTER (task = 'es') AS es, any_value(acc) FILTER (task = 'fr') AS fr
                   FROM res GROUP BY model)"""
        ),
        "baseline_delta": _with(
            """SELECT task, a.acc, b.acc AS baseline_acc, round(a.acc - b.acc, 1) AS delta
               FROM (SELECT * FROM res WHERE model = 'src1') a
               FULL JOIN (SELECT * FROM res WHERE model = 'src0') b USING (task)"""
        ),
    }
    out["tokenize_plugin"] = out["tokenize_ids"]
    out["bin_round_trip"] = out["bin_import"] = out["packed_chunks"]
    out["step_metrics"] = out["step_merge"]
    out["bin_blocks"] = out["packed_blocks"]
    return out
