"""The SQL that gives the same rows as the queries, built from the same vocabulary."""

from __future__ import annotations

from loomgraph.vocabulary import Retrieval, Vocabulary

_KEYWORDS = ("the", "with", "from", "nicht", "avec", "para", "and", "der", "les")
_PHRASES = ("of the", "and the", "in the", "nicht die", "dans un", "the and")
_SYNONYMS = {"ofthe": "of the", "the and": "and the"}
_RELATIONS = (("COMPARES", ("than", "als ")), ("DEPENDS_ON", ("with", "avec")), ("IMPLEMENTS", ("from", "para")), ("EXPLAINS", ("that", "nicht")))
_TYPES = (("algorithm", ("with", "avec")), ("technology", ("nicht", "from")))
_SHIPPED = Retrieval()
#: The threshold of the query that counts pruned paths.
PRUNING = 0.5
_IMPORTANCE = (("this|cette", 0.45), ("with|nicht", 0.35), ("from|avec", 0.30))


def VOCABULARY(max_ngram: int) -> Vocabulary:  # noqa: N802
    """Common words of the given tables; they hold none of the default ones."""
    return Vocabulary(_KEYWORDS, _PHRASES, _RELATIONS, dict(_SYNONYMS), _TYPES, _IMPORTANCE, 3, max_ngram)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _r6(x: str) -> str:
    """Rounded to six places as Spark rounds: the number's shortest decimal form, half up."""
    return f"round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), 6)::DOUBLE"


def _normal(x: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[`''"“”’]', '', 'g'), '[^a-z0-9가-힣\-\s_/+]', ' ', 'g'), '\s+', ' ', 'g'))"""


def _canonical(x: str) -> str:
    when = " ".join(f"WHEN {_quote(a)} THEN {_quote(b)}" for a, b in _SYNONYMS.items())
    return f"CASE {x} {when} ELSE CASE replace({x}, ' ', '') {when} ELSE {x} END END"


def _marked(x: str, rules, other: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, {_quote(m)})" for m in ms) + f" THEN '{name}'" for name, ms in rules) + f" ELSE '{other}' END"


def _id(x: str) -> str:
    return f"'ent:' || substr(sha1({x}), 1, 16)"


TURNS = """turns AS (SELECT 'conv-' || conv_id AS conversation_id, 't' || turn AS turn_id, 'conv-' || conv_id || ':t' || turn AS turn_uid, role AS speaker, coalesce(text, '') AS text,
    1770595200 + conv_id * 3600 + turn * 15 AS sec FROM conversations)"""


def _entities(p: str, source: str, key: str, text: str, n: int, tables: bool = False) -> str:
    """CTEs that end in {p}_ent(id, name, surface, type, conf, place). With ``tables`` the vocabulary is in CTEs: ph(k, surface),
    key_words(ks), a list, and syn(a, b)."""
    keywords = "ks" if tables else "[" + ", ".join(map(_quote, _KEYWORDS)) + "]"
    phrases = "ph" if tables else "(VALUES " + ", ".join(f"({i}, {_quote(x)})" for i, x in enumerate(_PHRASES)) + ") ph(k, surface)"
    name = "coalesce(s1.b, s2.b, nrm)" if tables else _canonical("nrm")
    known = "LEFT JOIN syn s1 ON s1.a = nrm LEFT JOIN syn s2 ON s2.a = replace(nrm, ' ', '')" if tables else ""
    grams = " UNION ALL ".join(
        f"SELECT id, unnest(list_transform(list_filter(range(1, len(tok) - {k} + 2), lambda i: list_has_any(tok[i:i + {k - 1}], {keywords})), lambda i: {{'s': array_to_string(tok[i:i + {k - 1}], ' '), 'o': {k} * 1000000 + i}})) AS g FROM {p}_tok{', key_words' if tables else ''} WHERE len(tok) >= {k}"
        for k in range(1, n + 1)
    )
    quoted = "list_concat(list_concat(" + ", ".join(f"regexp_extract_all(text, {_quote(f'{q}([^{q}]{{2,80}}){q}')}, 1)" for q in ("`", '"')) + f"), regexp_extract_all(text, {_quote(chr(39) + '([^' + chr(39) + ']{2,80})' + chr(39))}, 1))"
    return rf"""{p}_low AS (SELECT {key} AS id, {text} AS text, lower({text}) AS low FROM {source}),
    {p}_tok AS (SELECT id, regexp_extract_all(low, '[a-z0-9가-힣][a-z0-9가-힣\-+/]*') AS tok FROM {p}_low),
    {p}_cand AS (
        SELECT id, surface, 0 AS pri, -k AS ord, 0.90::DOUBLE AS conf FROM {p}_low JOIN {phrases} ON contains(low, surface)
        UNION ALL SELECT id, unnest(q), 1, generate_subscripts(q, 1), 0.82 FROM (SELECT id, {quoted} AS q FROM {p}_low)
        UNION ALL SELECT id, g.s, 2, g.o, 0.72 FROM ({grams}) WHERE length(g.s) >= 3
        UNION ALL SELECT id, unnest(a), 3, generate_subscripts(a, 1), 0.75 FROM (SELECT id, list_filter(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')) AS a FROM {p}_low)
    ),
    {p}_norm AS (SELECT *, {_normal('surface')} AS nrm FROM {p}_cand), {p}_named AS (SELECT {p}_norm.*, {name} AS name FROM {p}_norm {known}),
    {p}_one AS (SELECT * FROM {p}_named WHERE pri = 0 OR length(name) >= 3 QUALIFY row_number() OVER (PARTITION BY id, name ORDER BY pri, ord) = 1),
    {p}_ent AS (SELECT id, name, surface, {_marked('name', _TYPES, 'concept')} AS type, conf, row_number() OVER (PARTITION BY id ORDER BY conf DESC, name) - 1 AS place FROM {p}_one)"""


#: A large vocabulary out of the table itself: all pairs of its ``COMMON`` commonest words are phrases, pairs in the order of their
#: ranks are what the turned ones mean, the ``FURTHER`` next words are keywords.
COMMON, FURTHER = 100, 300
LARGE = rf"""ranked_words AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS r FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]{{{{3,}}}}')) AS w FROM turns) GROUP BY w),
    top_words AS (SELECT w, r FROM ranked_words WHERE r <= {COMMON}),
    ph AS (SELECT (a.r - 1) * {COMMON} + b.r AS k, a.w || ' ' || b.w AS surface FROM top_words a, top_words b),
    syn AS (SELECT a.w || ' ' || b.w AS a, b.w || ' ' || a.w AS b FROM top_words a, top_words b WHERE a.r > b.r),
    key_words AS (SELECT list(w) AS ks FROM ranked_words WHERE r > {COMMON} AND r <= {COMMON + FURTHER})""".replace("{{", "{").replace("}}", "}")

ENT2 = TURNS + ", " + _entities("t", "turns", "turn_uid", "text", 2)
CHAIN = (
    ENT2
    + f""", placed AS (SELECT e.id, name, place, CASE WHEN instr(low, name) > 0 THEN instr(low, name) - 1 ELSE 1000000 END AS pos, {_marked('low', _RELATIONS, 'RELATED_TO')} AS kind FROM t_ent e JOIN t_low l ON l.id = e.id),
    chain AS (SELECT id, name AS source, lead(name) OVER w AS target, kind, row_number() OVER w - 1 AS place FROM placed WINDOW w AS (PARTITION BY id ORDER BY pos, place)),
    links AS (SELECT * FROM chain WHERE target IS NOT NULL AND source <> target),
    rel AS (SELECT DISTINCT id AS turn_uid, {_id('source')} AS s, {_id('target')} AS t, kind FROM links)"""
)
MENTION = ENT2 + f""", men AS (SELECT e.id AS turn_uid, {_id('name')} AS entity_id, name, surface, type, t.sec, e.place FROM t_ent e JOIN turns t ON t.turn_uid = e.id)"""


def _entity_table(name: str, source: str) -> str:
    return f"""{name}_form AS (SELECT entity_id, surface, min((sec, turn_uid, place)) AS o, arg_min(name, (sec, turn_uid, place)) AS name, arg_min(type, (sec, turn_uid, place)) AS type FROM {source} GROUP BY ALL),
    {name} AS (SELECT entity_id, arg_min(name, o) AS canonical_name, arg_min(type, o) AS entity_type, list(surface ORDER BY o) AS aliases FROM {name}_form GROUP BY entity_id)"""


EDGES = "edge AS (SELECT s, t, kind, count(*)::DOUBLE AS weight, list(turn_uid ORDER BY turn_uid) AS evidence FROM rel GROUP BY ALL)"
PRIOR = "CASE relation_type WHEN 'EXPLAINS' THEN 1.0::DOUBLE WHEN 'DEPENDS_ON' THEN 0.95 WHEN 'IMPLEMENTS' THEN 0.92 WHEN 'COMPARES' THEN 0.82 WHEN 'RELATED_TO' THEN 0.70 ELSE 0.65 END"
ADJ = f"""both_ways AS (SELECT s AS source_entity_id, t AS target_entity_id, kind AS relation_type, weight, true AS forward FROM edge UNION ALL SELECT t, s, kind, weight, false FROM edge),
    adj_all AS (SELECT *, row_number() OVER (PARTITION BY source_entity_id ORDER BY weight DESC, target_entity_id, relation_type, forward DESC) AS place FROM both_ways),
    adj AS (SELECT *, least(1.2::DOUBLE, {PRIOR} * (1.0::DOUBLE + 0.08::DOUBLE * (weight - 1.0))) AS edge_score FROM adj_all WHERE place <= {max(40, 2 * _SHIPPED.beam_width)})"""
QNAMES = (
    _entities("q", "benchmark", "item_id", "text", 2)
    + f""", q_names AS (SELECT DISTINCT item_id AS query_id, coalesce(name, {_canonical(_normal('text'))}) AS name FROM benchmark b LEFT JOIN q_ent ON q_ent.id = b.item_id)"""
)
SEEDS = (
    QNAMES
    + """, forms AS (SELECT DISTINCT entity_id, canonical_name, lower(unnest(list_append(aliases, canonical_name))) AS form FROM ent),
    hit AS (SELECT DISTINCT n.name, f.entity_id, f.canonical_name FROM (SELECT DISTINCT name FROM q_names) n JOIN forms f ON contains(f.form, lower(n.name))),
    few AS (SELECT *, name = canonical_name AS exact FROM hit QUALIFY row_number() OVER (PARTITION BY name ORDER BY (name = canonical_name) DESC, length(canonical_name), entity_id) <= 20),
    seed0 AS (SELECT query_id, entity_id, canonical_name, max(0.85::DOUBLE * CASE WHEN exact THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END) AS score FROM q_names JOIN few USING (name) GROUP BY ALL),
    seed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS place FROM seed0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) <= 24)"""
)


def _hop(i: int, prune: float, beam: int) -> str:
    return f"""path{i} AS (SELECT query_id, a.target_entity_id AS entity_id, f.score * a.edge_score * 0.85::DOUBLE AS score, a.source_entity_id AS came, a.relation_type, a.forward,
            CASE WHEN f.path = '' THEN '' ELSE f.path || '>' END || a.relation_type || CASE WHEN a.forward THEN '+' ELSE '-' END || a.target_entity_id AS path,
            list_append(f.edges, (CASE WHEN a.forward THEN a.source_entity_id ELSE a.target_entity_id END) || '|' || (CASE WHEN a.forward THEN a.target_entity_id ELSE a.source_entity_id END) || '|' || a.relation_type) AS edges
        FROM front{i - 1} f JOIN adj a ON a.source_entity_id = f.entity_id),
    best{i} AS (SELECT * FROM path{i} WHERE score >= {prune} QUALIFY row_number() OVER (PARTITION BY query_id, entity_id ORDER BY score DESC, came, relation_type, forward DESC) = 1),
    front{i} AS (SELECT b.query_id, b.entity_id, b.score, b.path, b.edges FROM best{i} b LEFT JOIN reach{i - 1} r ON r.query_id = b.query_id AND r.entity_id = b.entity_id WHERE r.score IS NULL OR b.score > r.score
        QUALIFY row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, b.entity_id) <= {beam}),
    reach{i} AS (SELECT * FROM reach{i - 1} r WHERE NOT EXISTS (SELECT 1 FROM front{i} f WHERE f.query_id = r.query_id AND f.entity_id = r.entity_id) UNION ALL SELECT * FROM front{i})"""


def _reach(prune: float = _SHIPPED.prune_threshold, beam: int = _SHIPPED.beam_width) -> str:
    """CTEs that end in reach2(query_id, entity_id, score, path, edges)."""
    return f"""{SEEDS}, reach0 AS (SELECT query_id, entity_id, greatest(0.01::DOUBLE, score) AS score, '' AS path, []::VARCHAR[] AS edges FROM seed),
    front0 AS (SELECT * FROM reach0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) <= {beam}), {_hop(1, prune, beam)}, {_hop(2, prune, beam)}"""


REACH = _reach()
GRAPH = CHAIN + f""", men AS (SELECT e.id AS turn_uid, {_id('name')} AS entity_id, name, surface, type, t.sec, e.place FROM t_ent e JOIN turns t ON t.turn_uid = e.id), """ + _entity_table("ent", "men") + ", " + EDGES + ", " + ADJ
POST = r"""terms AS (SELECT turn_uid, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS tl FROM turns),
    post AS (SELECT term, turn_uid, count(*) AS tf, any_value(n) AS len FROM (SELECT turn_uid, len(tl) AS n, unnest(tl) AS term FROM terms) GROUP BY term, turn_uid)"""


def _search(limit: int) -> str:
    return rf"""size_of AS (SELECT count(*) AS n, avg(len(tl)) AS avg_len FROM terms),
    asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
    idf AS (SELECT term, ln(1.0::DOUBLE + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf, avg_len FROM post, size_of WHERE term IN (SELECT term FROM asked) GROUP BY term, n, avg_len),
    bm AS (SELECT query_id, turn_uid, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 9) AS lexical_raw FROM asked JOIN idf USING (term) JOIN post USING (term) GROUP BY ALL),
    hits AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical_raw DESC, turn_uid) <= {limit})"""


RECALL = "recall AS (SELECT 'conv-' || user_id || ':t0' AS turn_uid, count(*) AS recall_count, epoch_us(max(ts) + INTERVAL 770 DAY) AS last_us FROM events GROUP BY ALL)"
CHUNK_LINES = r"""list_filter(list_transform(regexp_split_to_array(body, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]'), lambda l: trim(l, chr(32) || chr(9))), lambda l: l <> '')"""


def _chunks(source: str, key: str) -> str:
    """CTEs that end in chunk(id, profile, size, overlap, i, chunk)."""
    return rf"""ck_body AS (SELECT {key} AS id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS body FROM {source}),
    ck_lines AS (SELECT id, body, {CHUNK_LINES} AS ls, list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '') AS ws FROM ck_body),
    ck_head AS (SELECT *, len(list_filter(ls, lambda l: regexp_matches(l, '^(?:[-*•]\s+|\d+[.)]\s+|#{{1,6}}\s+)') OR (length(l) <= 64 AND suffix(l, ':')) OR regexp_full_match(l, '[가-힣A-Za-z0-9 _/\-]{{2,48}}'))) AS h FROM ck_lines),
    ck_kind AS (SELECT id, body, ws, CASE WHEN body <> '' AND len(ls) >= 3 AND h >= 0.20 * len(ls) THEN 'structured' ELSE 'default' END AS profile FROM ck_head),
    ck_size AS (SELECT *, CASE profile WHEN 'structured' THEN 48 ELSE 64 END AS size, CASE profile WHEN 'structured' THEN 6 ELSE 8 END AS overlap FROM ck_kind),
    chunk_list AS (SELECT *, CASE WHEN len(ws) <= size THEN [body] ELSE list_transform(range(0, 1 + ceil((len(ws) - size) / (size - overlap))::BIGINT), lambda i: array_to_string(ws[i * (size - overlap) + 1:i * (size - overlap) + size], ' ')) END AS cs FROM ck_size),
    chunk AS (SELECT id, profile, size, overlap, generate_subscripts(cs, 1) - 1 AS i, unnest(cs) AS chunk FROM chunk_list)"""


def _vectors(p: str, source: str, key: str, text: str) -> str:
    """CTEs that end in {p}_vec(key..., dim, value): the parts that are not zero."""
    return rf"""{p}_tk AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-zA-Z0-9가-힣_\-+/]+')) AS tk FROM {source}),
    {p}_raw AS (SELECT {key}, (('0x' || substr(sha1(tk), 1, 8))::BIGINT % 64) AS dim, sum(CASE WHEN ('0x' || substr(sha1(tk), 9, 2))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END) AS v FROM {p}_tk GROUP BY ALL),
    {p}_len AS (SELECT {key}, sqrt(sum(v * v)) AS l FROM {p}_raw GROUP BY ALL),
    {p}_vec AS (SELECT {key}, dim, CASE WHEN l <= 1e-9 THEN v ELSE v / l END AS value FROM {p}_raw JOIN {p}_len USING ({key}))"""


TURN_VECTORS = (
    _chunks("turns", "turn_uid") + ", ck AS (SELECT id, i, chunk FROM chunk), " + _vectors("ck", "ck", "id, i", "chunk")
    + """, ck_n AS (SELECT id, count(*) AS n FROM ck GROUP BY id), mean0 AS (SELECT id, dim, sum(value ORDER BY i) / any_value(n) AS v FROM ck_vec JOIN ck_n USING (id) GROUP BY id, dim),
    mean_len AS (SELECT id, sqrt(sum(v * v ORDER BY dim)) AS l FROM mean0 GROUP BY id), mean AS (SELECT id, dim, CASE WHEN l <= 1e-9 THEN v ELSE v / l END AS value FROM mean0 JOIN mean_len USING (id))"""
)


def _pool(hybrid: bool) -> str:
    """CTEs that end in cand(query_id, turn_uid, lexical_raw) and matched(query_id, turn_uid, entity_id)."""
    base = """mention AS (SELECT DISTINCT turn_uid, entity_id FROM men),
    g0 AS (SELECT query_id, turn_uid, round(sum(score ORDER BY entity_id), 9) AS total FROM reach2 JOIN mention USING (entity_id) GROUP BY ALL),
    g1 AS (SELECT * FROM g0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total DESC, turn_uid) <= 400),
    gm AS (SELECT query_id, turn_uid, entity_id FROM g1 JOIN reach2 USING (query_id) JOIN mention USING (turn_uid, entity_id)), """
    if not hybrid:
        return base + "matched AS (SELECT DISTINCT * FROM gm), cand AS (SELECT query_id, turn_uid, NULL::DOUBLE AS lexical_raw FROM g1)"
    return (
        base + POST + ", " + _search(400)
        + """, matched AS (SELECT * FROM gm UNION SELECT query_id, turn_uid, entity_id FROM hits JOIN mention USING (turn_uid)),
    cand AS (SELECT query_id, turn_uid, lexical_raw FROM g1 FULL JOIN hits USING (query_id, turn_uid))"""
    )


def _fused(hybrid: bool, g: float, e: float, x: float, importance: float, recency: float) -> str:
    """CTEs that end in fused(query_id, turn_uid, score, ...)."""
    imp = " + ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN {w}::DOUBLE ELSE 0 END" for p, w in _IMPORTANCE)
    return f"""{_pool(hybrid)}, {RECALL}, {TURN_VECTORS}, {_vectors('bq', 'benchmark', 'item_id', 'text')},
    sig AS (SELECT query_id, turn_uid, least(1.0::DOUBLE, sum(coalesce(score, 0.0) ORDER BY entity_id) / count(*)) AS entity_score FROM matched LEFT JOIN reach2 USING (query_id, entity_id) GROUP BY ALL),
    steps AS (SELECT DISTINCT query_id, turn_uid, unnest(edges) AS e FROM matched JOIN reach2 USING (query_id, entity_id)),
    proof AS (SELECT s || '|' || t || '|' || kind AS e, unnest(evidence) AS turn_uid FROM edge),
    bonus AS (SELECT DISTINCT query_id, turn_uid FROM steps JOIN proof USING (e, turn_uid)),
    sim AS (SELECT c.query_id, c.turn_uid, sum(m.value * q.value ORDER BY m.dim) AS cos FROM cand c JOIN mean m ON m.id = c.turn_uid JOIN bq_vec q ON q.item_id = c.query_id AND q.dim = m.dim GROUP BY ALL),
    span AS (SELECT query_id, min(lexical_raw) AS lo, max(lexical_raw) AS hi FROM cand GROUP BY ALL),
    parts AS (
        SELECT c.query_id, c.turn_uid, coalesce(entity_score, 0.0) AS entity_score, CASE WHEN b.turn_uid IS NULL THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS bonus,
            CASE WHEN lexical_raw IS NULL THEN 0.0::DOUBLE WHEN hi - lo <= 1e-9 THEN CASE WHEN lexical_raw > 0 THEN 1.0 ELSE 0.0 END ELSE (lexical_raw - lo) / (hi - lo) END AS lex,
            greatest(0.0::DOUBLE, coalesce(cos, 0.0)) AS emb, {importance}::DOUBLE * least(1.0::DOUBLE, round({imp}, 6)) AS imp,
            {recency}::DOUBLE * exp(-0.6931471805599453::DOUBLE * greatest(0.0, (1775001600000000 - coalesce(last_us, t.sec * 1000000)) / 3.6e9::DOUBLE) / 72.0::DOUBLE) AS rec, t.text
        FROM cand c JOIN turns t ON t.turn_uid = c.turn_uid JOIN span USING (query_id) LEFT JOIN sig ON sig.query_id = c.query_id AND sig.turn_uid = c.turn_uid
        LEFT JOIN bonus b ON b.query_id = c.query_id AND b.turn_uid = c.turn_uid LEFT JOIN sim ON sim.query_id = c.query_id AND sim.turn_uid = c.turn_uid LEFT JOIN recall r ON r.turn_uid = c.turn_uid
    ),
    fused AS (SELECT query_id, turn_uid, text, least(1.0::DOUBLE, entity_score + bonus) AS gs, emb, lex, imp, rec, {_r6(f'({g}::DOUBLE * least(1.0::DOUBLE, entity_score + bonus) + {e}::DOUBLE * emb + {x}::DOUBLE * lex + imp + rec)')} AS score FROM parts)"""


TOP = f"""SELECT query_id, turn_uid, row_number() OVER w AS rank, score, {_r6('gs')} AS graph_signal, {_r6('emb')} AS embedding_signal, {_r6('lex')} AS lexical_signal,
    {_r6('imp')} AS importance_component, {_r6('rec')} AS recency_component FROM fused WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, turn_uid) QUALIFY row_number() OVER w <= 10"""
HYBRID = _fused(True, 0.62, 0.23, 0.15, 0.1, 0.1)


def _edges_out(source: str) -> str:
    return f"SELECT s AS source_entity_id, t AS target_entity_id, kind AS relation_type, weight, len(evidence) AS n_evidence, md5(array_to_string(evidence, ',')) AS evidence_md5 FROM {source}"


_RERANKED = f"({_SHIPPED.rerank_weight}::DOUBLE * CASE WHEN hi - lo <= 1e-9 THEN CASE WHEN raw > 0 THEN 1.0 ELSE 0.0 END ELSE (raw - lo) / (hi - lo) END)"
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(turn_uid) + 1), lambda i: ascii(turn_uid[i])::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), list_transform(range(8), lambda k: k)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""
HALVES = f"crc AS (SELECT turn_uid, xor({_CRC}, 4294967295) % 3 AS m FROM turns)"

ORACLE = {
    "text_names": f"WITH {TURNS}, n AS (SELECT turn_uid, {_normal('text')} AS normal FROM turns), c AS (SELECT *, {_canonical('normal')} AS canonical FROM n) SELECT *, {_id('canonical')} AS entity_id, {_marked('canonical', _TYPES, 'concept')} AS entity_type FROM c",
    "text_importance": f"WITH {TURNS} SELECT turn_uid, least(1.0::DOUBLE, round({' + '.join(f'CASE WHEN regexp_matches(text, {_quote("(?i)" + p)}) THEN {w}::DOUBLE ELSE 0 END' for p, w in _IMPORTANCE)}, 6)) AS importance, {_marked('lower(text)', _RELATIONS, 'RELATED_TO')} AS relation_type FROM turns",
    "chunk_documents": f"WITH {_chunks('documents', 'doc_id::VARCHAR')} SELECT id AS turn_uid, i AS chunk_no, md5(chunk) AS chunk_md5, profile AS chunk_profile, size AS chunk_size, overlap AS chunk_overlap FROM chunk",
    "embed_turns": f"WITH {TURNS}, {_vectors('v', 'turns', 'turn_uid', 'text')} SELECT turn_uid, dim, round(value, 6) AS value FROM v_vec WHERE round(value, 6) <> 0",
    "embed_chunk_means": f"WITH {TURNS}, {TURN_VECTORS} SELECT id AS turn_uid, dim, round(value, 6) AS value FROM mean WHERE round(value, 6) <> 0",
    "cosine_to_queries": """WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
        n AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_dot_product(q.e, r.e), 6) AS likeness FROM u q JOIN u r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)
        SELECT *, row_number() OVER w AS rank FROM n WINDOW w AS (PARTITION BY query_id ORDER BY likeness DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "extract_entities": f"WITH {TURNS}, {_entities('t', 'turns', 'turn_uid', 'text', 3)} SELECT id AS turn_uid, place, name AS canonical_name, surface, type AS entity_type, conf AS confidence FROM t_ent",
    "extract_relations": f"WITH {CHAIN} SELECT id AS turn_uid, place, source, target, kind AS relation_type, CASE kind WHEN 'RELATED_TO' THEN 0.62::DOUBLE ELSE 0.78 END AS confidence FROM links",
    "graph_entities": f"WITH {MENTION}, {_entity_table('ent', 'men')} SELECT entity_id, canonical_name, entity_type, array_to_string(aliases, '|') AS aliases FROM ent",
    "graph_mentions": f"WITH {MENTION} SELECT DISTINCT turn_uid, entity_id FROM men",
    "graph_relations": f"WITH {CHAIN}, {EDGES} {_edges_out('edge')}",
    "graph_evidence": f"WITH {CHAIN} SELECT DISTINCT s AS source_entity_id, t AS target_entity_id, kind AS relation_type, turn_uid FROM rel",
    "graph_adjacency": f"WITH {CHAIN}, {EDGES}, {ADJ} SELECT source_entity_id, target_entity_id, relation_type, forward, weight, place, round(edge_score, 6) AS edge_score FROM adj WHERE place <= 40",
    "graph_merge_relations": f"WITH {CHAIN}, {HALVES}, twice AS (SELECT s, t, kind, sum(CASE WHEN m = 2 THEN 2 ELSE 1 END)::DOUBLE AS weight, list(turn_uid ORDER BY turn_uid) AS evidence FROM rel JOIN crc USING (turn_uid) GROUP BY ALL) {_edges_out('twice')}",
    "graph_merge_entities": f"""WITH {MENTION}, {HALVES}, ma AS (SELECT men.* FROM men JOIN crc USING (turn_uid) WHERE m <> 0), mb AS (SELECT men.* FROM men JOIN crc USING (turn_uid) WHERE m <> 1), {_entity_table('ea', 'ma')}, {_entity_table('eb', 'mb')}
        SELECT coalesce(ea.entity_id, eb.entity_id) AS entity_id, coalesce(ea.canonical_name, eb.canonical_name) AS canonical_name, coalesce(ea.entity_type, eb.entity_type) AS entity_type,
            array_to_string(list_concat(coalesce(ea.aliases, []), list_filter(coalesce(eb.aliases, []), lambda x: NOT list_contains(coalesce(ea.aliases, []), x))), '|') AS aliases FROM ea FULL JOIN eb ON ea.entity_id = eb.entity_id""",
    "skip_stored": f"WITH {TURNS} SELECT turn_uid, speaker FROM turns WHERE turn_uid NOT IN (SELECT turn_uid FROM turns WHERE speaker = 'user')",
    "ingest_statistics": f"""WITH {CHAIN}, {_chunks('turns', 'turn_uid')}, pc AS (SELECT id, profile, count(*) AS c FROM chunk GROUP BY ALL)
        SELECT (SELECT count(*) FROM turns) AS turns, (SELECT count(*) FROM t_ent) AS mentions, count(*) AS relations, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k.lower()}" for k in ('COMPARES', 'DEPENDS_ON', 'IMPLEMENTS', 'EXPLAINS', 'RELATED_TO'))},
            (SELECT count(*) FROM pc WHERE profile = 'default') AS chunks_default, (SELECT count(*) FROM pc WHERE profile = 'structured') AS chunks_structured,
            (SELECT round(sum(c)::DOUBLE / count(*), 3) FROM pc) AS avg_chunks, (SELECT max(c) FROM pc) AS max_chunks FROM rel""",
    "conversation_turns": f"WITH {TURNS} SELECT conversation_id, turn_uid, row_number() OVER w AS place, sec AS at FROM turns WINDOW w AS (PARTITION BY conversation_id ORDER BY sec, turn_id) QUALIFY row_number() OVER w <= 10000",
    "extract_entities_large": f"WITH {TURNS}, {LARGE}, {_entities('t', 'turns', 'turn_uid', 'text', 1, True)} SELECT id AS turn_uid, place, name AS canonical_name, surface, type AS entity_type, conf AS confidence FROM t_ent",
    "query_seeds": f"WITH {MENTION}, {_entity_table('ent', 'men')}, {SEEDS} SELECT query_id, entity_id, canonical_name, round(score, 6) AS score, place FROM seed",
    "beam_traversal": f"WITH {GRAPH}, {REACH} SELECT query_id, entity_id, round(score, 6) AS score, path FROM reach2",
    "beam_pruned": f"""WITH {GRAPH}, {_reach(prune=PRUNING)}, fell AS (SELECT query_id FROM path1 WHERE score < {PRUNING} UNION ALL SELECT query_id FROM path2 WHERE score < {PRUNING})
        SELECT item_id AS query_id, count(f.query_id) AS pruned FROM benchmark LEFT JOIN fell f ON f.query_id = item_id GROUP BY ALL""",
    "text_postings": f"WITH {TURNS}, {POST} SELECT term, turn_uid, tf, len FROM post",
    "text_search": f"WITH {TURNS}, {POST}, {_search(200)} SELECT query_id, turn_uid, round(lexical_raw, 6) AS lexical_raw FROM hits",
    "recall_state": f"WITH {RECALL} SELECT turn_uid, recall_count, last_us FROM recall",
    "candidate_pool": f"WITH {GRAPH}, {REACH}, {_pool(True)} SELECT query_id, turn_uid, lexical_raw IS NOT NULL AS by_text, coalesce(n, 0) AS n_matched FROM cand LEFT JOIN (SELECT query_id, turn_uid, count(*) AS n FROM matched GROUP BY ALL) USING (query_id, turn_uid)",
    "retrieve_hybrid": f"WITH {GRAPH}, {REACH}, {HYBRID} {TOP}",
    "retrieve_graph_only": f"WITH {GRAPH}, {REACH}, {_fused(False, 1.0, 0.0, 0.0, 0.0, 0.0)} {TOP}",
    "retrieve_reranked": f"""WITH {GRAPH}, {REACH}, {HYBRID}, place AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, turn_uid) AS p FROM fused),
        raw AS (SELECT query_id, turn_uid, length(b.text)::DOUBLE / greatest(1, length(b.text) + length(place.text)) AS raw FROM place JOIN benchmark b ON b.item_id = query_id WHERE p <= 5),
        mm AS (SELECT query_id, min(raw) AS lo, max(raw) AS hi FROM raw GROUP BY ALL),
        done AS (SELECT p.query_id, p.turn_uid, p <= 5 AS head, coalesce({_r6(_RERANKED)}, 0.0) AS rerank_component, p.score FROM place p LEFT JOIN raw USING (query_id, turn_uid) JOIN mm USING (query_id)),
        added AS (SELECT *, {_r6('(score + rerank_component)')} AS total FROM done)
        SELECT query_id, turn_uid, row_number() OVER w AS rank, total AS score, rerank_component FROM added WINDOW w AS (PARTITION BY query_id ORDER BY head DESC, total DESC, turn_uid) QUALIFY row_number() OVER w <= 10""",
    "retrieve_traced": f"""WITH {GRAPH}, {REACH}, {HYBRID}, top AS ({TOP}), nm AS (SELECT query_id, turn_uid, list_sort(list(DISTINCT canonical_name)) AS names FROM top JOIN matched USING (query_id, turn_uid) JOIN ent USING (entity_id) GROUP BY ALL),
        st AS (SELECT query_id, turn_uid, path, edges FROM top JOIN matched USING (query_id, turn_uid) JOIN reach2 USING (query_id, entity_id)),
        un AS (SELECT DISTINCT query_id, turn_uid, e, regexp_extract(step, '([+-])(ent:.*)$', 1) AS dir FROM (SELECT query_id, turn_uid, unnest(edges) AS e, unnest(string_split(path, '>')) AS step FROM st WHERE path <> '')),
        ns AS (SELECT query_id, turn_uid, least(8, count(*)) AS n_steps FROM un GROUP BY ALL),
        ev AS (SELECT query_id, u.turn_uid, list_sort(list(DISTINCT p.turn_uid)) AS evs FROM un u JOIN proof p ON p.e = u.e GROUP BY ALL)
        SELECT query_id, turn_uid, rank, coalesce(array_to_string(names, '|'), '') AS matched, coalesce(n_steps, 0) AS n_steps, coalesce(len(evs), 0) AS n_evidence, md5(coalesce(array_to_string(evs, ','), '')) AS evidence_md5
        FROM top LEFT JOIN nm USING (query_id, turn_uid) LEFT JOIN ns USING (query_id, turn_uid) LEFT JOIN ev USING (query_id, turn_uid)""",
    "subgraph_edges": f"""WITH {GRAPH}, names(name) AS (VALUES {', '.join(f'({_quote(k)})' for k in _KEYWORDS)}), forms AS (SELECT DISTINCT entity_id, canonical_name, lower(unnest(list_append(aliases, canonical_name))) AS form FROM ent),
        hit AS (SELECT DISTINCT n.name, f.entity_id, f.canonical_name FROM names n JOIN forms f ON contains(f.form, n.name)),
        few AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY (name = canonical_name) DESC, length(canonical_name), entity_id) AS sp FROM hit QUALIFY row_number() OVER (PARTITION BY name ORDER BY (name = canonical_name) DESC, length(canonical_name), entity_id) <= 8),
        cap AS (SELECT *, greatest(12, 100 // count(*) OVER (PARTITION BY name)) AS most FROM few),
        near AS (SELECT name, sp, a.* FROM cap JOIN (SELECT * FROM adj_all WHERE place <= 100) a ON a.source_entity_id = cap.entity_id WHERE a.place <= most),
        once AS (SELECT name, source_entity_id AS source, target_entity_id AS target, relation_type AS label, min((sp, place)) AS o FROM near GROUP BY ALL)
        SELECT name, source, target, label FROM once QUALIFY row_number() OVER (PARTITION BY name ORDER BY o, target, label) <= 100""",
    "evaluate_search": rf"""WITH {TURNS}, {POST}, words AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark), relevant AS (SELECT DISTINCT item_id, turn_uid FROM words JOIN post USING (term) WHERE length(term) >= 7),
        {_search(10)}, ranked AS (SELECT query_id AS item_id, turn_uid, row_number() OVER (PARTITION BY query_id ORDER BY lexical_raw DESC, turn_uid) AS rank FROM hits),
        n AS (SELECT item_id, count(*) AS n FROM relevant GROUP BY ALL), k(k) AS (VALUES (1), (5), (10)),
        j AS (SELECT r.item_id, k, any_value(n) AS n, count(*) FILTER (rank <= k) AS found, min(rank) AS best, sum(CASE WHEN rank <= k THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg FROM relevant r JOIN n USING (item_id) CROSS JOIN k LEFT JOIN ranked USING (item_id, turn_uid) GROUP BY ALL)
        SELECT 'text' AS profile, k, count(*) AS examples, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr, round(avg(found::DOUBLE / n), 6) AS recall,
            round(avg(dcg / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1.0::DOUBLE / log2(i + 1)))), 6) AS ndcg, round(avg(CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit FROM j GROUP BY k""",
}
_WEIGHTS = "('lexical_only', 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE), ('embedding_only', 0.0, 1.0, 0.0), ('hybrid', 0.62, 0.23, 0.15), ('hybrid_rerank', 0.62, 0.23, 0.15)"
ORACLE["compare_profiles"] = rf"""WITH {GRAPH}, {REACH}, {_fused(True, 0.62, 0.23, 0.15, 0.0, 0.0)}, words AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
    relevant AS (SELECT DISTINCT item_id, turn_uid FROM words JOIN post USING (term) WHERE length(term) >= 7), n AS (SELECT item_id, count(*) AS n FROM relevant GROUP BY ALL),
    alone AS (SELECT query_id, turn_uid, least(1.0::DOUBLE, sum(score ORDER BY entity_id) / count(*)) AS entity_score FROM gm JOIN reach2 USING (query_id, entity_id) GROUP BY ALL),
    scored AS (
        SELECT 'graph_only' AS profile, query_id, turn_uid, {_r6('least(1.0::DOUBLE, entity_score + CASE WHEN b.turn_uid IS NULL THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END)')} AS score, NULL AS text FROM alone LEFT JOIN bonus b USING (query_id, turn_uid)
        UNION ALL SELECT p.profile, query_id, turn_uid, {_r6('(p.g * gs + p.e * emb + p.x * lex)')}, text FROM fused CROSS JOIN (VALUES {_WEIGHTS}) p(profile, g, e, x)
    ),
    seated AS (SELECT *, row_number() OVER (PARTITION BY profile, query_id ORDER BY score DESC, turn_uid) AS p FROM scored),
    raw AS (SELECT query_id, turn_uid, length(b.text)::DOUBLE / greatest(1, length(b.text) + length(seated.text)) AS raw FROM seated JOIN benchmark b ON b.item_id = query_id WHERE profile = 'hybrid_rerank' AND p <= {_SHIPPED.rerank_top_n}),
    mm AS (SELECT query_id, min(raw) AS lo, max(raw) AS hi FROM raw GROUP BY ALL),
    added AS (SELECT profile, query_id, turn_uid, 0 AS tail, score AS total FROM seated WHERE profile <> 'hybrid_rerank'
        UNION ALL SELECT profile, query_id, turn_uid, CASE WHEN raw IS NULL THEN 1 ELSE 0 END, {_r6('(score + coalesce(' + _r6(_RERANKED) + ', 0.0))')}
        FROM seated LEFT JOIN raw USING (query_id, turn_uid) LEFT JOIN mm USING (query_id) WHERE profile = 'hybrid_rerank'),
    ranked AS (SELECT profile, query_id AS item_id, turn_uid, row_number() OVER w AS rank FROM added WINDOW w AS (PARTITION BY profile, query_id ORDER BY tail, total DESC, turn_uid) QUALIFY row_number() OVER w <= 10),
    k(k) AS (VALUES (1), (5), (10)), profiles AS (SELECT DISTINCT unnest(['graph_only', 'lexical_only', 'embedding_only', 'hybrid', 'hybrid_rerank']) AS profile),
    j AS (SELECT profile, r.item_id, k, any_value(n) AS n, count(*) FILTER (rank <= k) AS found, min(rank) AS best, sum(CASE WHEN rank <= k THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg
        FROM profiles CROSS JOIN relevant r JOIN n USING (item_id) CROSS JOIN k LEFT JOIN ranked USING (profile, item_id, turn_uid) GROUP BY ALL),
    m AS (SELECT profile, k, count(*) AS examples, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr, round(avg(found::DOUBLE / n), 6) AS recall,
        round(avg(dcg / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1.0::DOUBLE / log2(i + 1)))), 6) AS ndcg, round(avg(CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit FROM j GROUP BY profile, k)
    SELECT m.*, round(m.mrr - b.mrr, 6) AS delta_mrr, round(m.recall - b.recall, 6) AS delta_recall FROM m JOIN m b ON b.k = m.k AND b.profile = 'graph_only'"""
_RELEVANT = r"""words AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark), relevant AS (SELECT DISTINCT item_id, turn_uid FROM words JOIN post USING (term) WHERE length(term) >= 7)"""
ORACLE["graph_merge_turns"] = f"""WITH {TURNS}, {RECALL} SELECT t.turn_uid, speaker, md5(text || '!') AS text_md5, CASE WHEN speaker = 'user' THEN coalesce(recall_count, 0) ELSE 0 END AS recall_count FROM turns t LEFT JOIN recall r ON r.turn_uid = t.turn_uid"""
ORACLE["graph_rebuild"] = ORACLE["graph_relations"]
ORACLE["graph_lookups"] = f"""WITH {MENTION}, {_entity_table('ent', 'men')}, {QNAMES}, uid AS (SELECT DISTINCT 'conv-' || user_id || ':t0' AS turn_uid FROM events)
    SELECT 'entity' AS kind, entity_id AS id, canonical_name AS what FROM ent WHERE entity_id IN (SELECT {_id('name')} FROM q_names) UNION ALL SELECT 'turn', turn_uid, speaker FROM turns JOIN uid USING (turn_uid) UNION ALL SELECT 'exists', turn_uid, '' FROM turns JOIN uid USING (turn_uid)"""
_EDGES_SQL = ORACLE["subgraph_edges"]
ORACLE["subgraph_nodes"] = _EDGES_SQL[: _EDGES_SQL.rindex("SELECT name, source")].rstrip() + """, out AS (SELECT name, source, target, label FROM once QUALIFY row_number() OVER (PARTITION BY name ORDER BY o, target, label) <= 100),
    node AS (SELECT name, entity_id AS id, 1.0::DOUBLE AS score FROM few UNION ALL SELECT name, target, 0.6 FROM out) SELECT name, id, max(score) AS score, any_value(canonical_name) AS label, any_value(entity_type) AS kind FROM node JOIN ent ON ent.entity_id = node.id GROUP BY name, id"""
ORACLE["recall_feedback"] = f"""WITH {TURNS}, {POST}, {_search(10)}, log AS (SELECT turn_uid, 1775001600000000 AS us FROM hits UNION ALL SELECT 'conv-' || user_id || ':t0', epoch_us(ts + INTERVAL 770 DAY) FROM events), n AS (SELECT turn_uid, count(*) AS c, max(us) AS last_us FROM log GROUP BY ALL)
    SELECT t.turn_uid, coalesce(c, 0) AS recall_count, last_us FROM turns t LEFT JOIN n ON n.turn_uid = t.turn_uid"""
ORACLE["eval_examples"] = """WITH l AS (SELECT * FROM labels), kept AS (SELECT item_id AS example_id, text AS query, 1770000000 + item_id * 86400 AS created FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM l)
    UNION ALL SELECT doc_id, 'document ' || doc_id, 1770000000 + coalesce(item_id, doc_id + 1000) * 86400 FROM l LEFT JOIN benchmark ON item_id = doc_id)
    SELECT example_id, md5(query) AS query_md5, created FROM kept WHERE example_id NOT IN (SELECT doc_id FROM l WHERE toxic = 1)"""
_ONE_HOP = f"""{SEEDS}, reach0 AS (SELECT query_id, entity_id, greatest(0.01::DOUBLE, score) AS score, '' AS path, []::VARCHAR[] AS edges FROM seed),
    front0 AS (SELECT * FROM reach0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) <= {_SHIPPED.beam_width}), {_hop(1, _SHIPPED.prune_threshold, _SHIPPED.beam_width)}, reach2 AS (SELECT * FROM reach1)"""
ORACLE["evaluate_details"] = f"""WITH {GRAPH}, {_ONE_HOP}, {_fused(False, 1.0, 0.0, 0.0, 0.0, 0.0)}, {POST}, {_RELEVANT}, n AS (SELECT item_id, count(*) AS n FROM relevant GROUP BY ALL),
    top AS (SELECT query_id, turn_uid, row_number() OVER w AS rank FROM fused WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, turn_uid) QUALIFY row_number() OVER w <= 10)
    SELECT 'graph_only' AS profile, item_id AS example_id, any_value(n) AS n_relevant, coalesce(string_agg(turn_uid, ',' ORDER BY rank), '') AS ranked FROM n LEFT JOIN top ON query_id = item_id GROUP BY item_id"""
ORACLE["files_turns"] = f"""WITH {TURNS} SELECT '' AS reason, turn_uid, speaker, md5(text) AS text_md5, sec AS at FROM turns WHERE speaker <> 'system' AND text <> ''
    UNION ALL SELECT CASE WHEN speaker = 'system' THEN 'missing text' ELSE 'empty text' END AS r, '', '', '', count(*) FROM turns WHERE speaker = 'system' OR text = '' GROUP BY r"""
_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
ORACLE["files_sessions"] = rf"""WITH k AS (SELECT *, {_STRIPPED} AS body FROM conversations WHERE role = 'user') SELECT 'codex:s' || conv_id AS conversation_id, 'turn-' || printf('%06d', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS turn_id, md5(body) AS text_md5, conv_id * 1000 + turn AS at FROM k WHERE body <> ''"""
ORACLE["files_events"] = rf"""WITH k AS (SELECT *, {_STRIPPED} AS body FROM conversations WHERE role IN ('user', 'assistant')), t AS (SELECT *, CASE WHEN role = 'user' THEN body WHEN coalesce(body, '') = '' THEN '[tool_use] grep' ELSE body || chr(10) || '[tool_use] grep' END AS said FROM k)
    SELECT 'claude:s' || conv_id AS conversation_id, 'u-' || conv_id || '-' || turn AS turn_id, role AS speaker, md5(said) AS text_md5 FROM t WHERE said <> ''"""
ORACLE["files_examples"] = rf"""WITH {TURNS}, {POST}, {_RELEVANT} SELECT '' AS reason, md5(regexp_replace(b.text, '^\s+|\s+$', '', 'g')) AS query_md5, string_agg(r.turn_uid, ',' ORDER BY r.turn_uid) AS relevant, 1 AS n FROM relevant r JOIN benchmark b USING (item_id) GROUP BY item_id, b.text
    UNION ALL SELECT 'no relevant turns', '', '', count(*) FROM benchmark"""
ORACLE["embed_turns_builtin"] = ORACLE["embed_turns"]
ORACLE["graph_stored"] = ORACLE["stream_ingested"] = ORACLE["graph_relations"]
ORACLE["stream_recalled"] = ORACLE["recall_state"]
ORACLE["report_written"] = ORACLE["evaluate_search"]
ORACLE["files_first"] = rf"""SELECT 'claude:s' || conv_id AS conversation_id, 'u-' || conv_id || '-' || turn AS turn_id, role AS speaker, md5({_STRIPPED}) AS text_md5 FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 4 < 2 AND {_STRIPPED} <> ''"""
ORACLE["files_both"] = f"""SELECT conversation_id, turn_id, 'user' AS speaker, text_md5 FROM ({ORACLE["files_sessions"]}) UNION ALL
    SELECT 'claude:s' || conv_id, 'u-' || conv_id || '-' || turn, CASE role WHEN 'assistant' THEN role ELSE 'user' END, md5({_STRIPPED}) FROM conversations WHERE {_STRIPPED} <> ''"""
ORACLE["turns_moved"] = "SELECT 'all' AS conversation_id, 't' || turn AS turn_id, role AS speaker, count(*) AS n FROM conversations GROUP BY ALL"
ORACLE["eval_listed"] = rf"""WITH v AS (SELECT item_id AS example_id, {_STRIPPED} AS q, 1770000000 + item_id % 7 * 86400 AS created FROM benchmark WHERE item_id % 3 <> 0 AND item_id % 5 <> 0 AND {_STRIPPED} <> '')
    SELECT example_id, md5(q) AS query_md5, 'conv-' || example_id || ':t0' AS relevant, created, (SELECT count(*) FROM v) AS examples FROM v ORDER BY created DESC, example_id LIMIT 100"""
ORACLE["retrieve_own"] = "SELECT item_id AS query_id, item_id % 4 + 1 AS n, (item_id % 4 + 1)::VARCHAR AS top_k, '1' AS max_hops, '24' AS beam_width, 'true' AS hybrid_enabled, '0.1' AS importance_weight FROM benchmark WHERE item_id % 3 <> 0"
ORACLE["text_search_index"] = ORACLE["text_search"]
ORACLE["text_index_postings"] = ORACLE["text_postings"]
ORACLE["retrieve_indexed"] = ORACLE["retrieve_hybrid"]


def _own_hop(i: int) -> str:
    """A hop in which each query of own(query_id, hops, beam, prune) has its own width, threshold and number of hops."""
    hop = _hop(i, -1, 0)
    hop = hop.replace("JOIN adj a ON a.source_entity_id = f.entity_id)", f"JOIN own o ON o.query_id = f.query_id AND o.hops >= {i} JOIN adj a ON a.source_entity_id = f.entity_id AND a.place <= greatest(40, 2 * o.beam))")
    hop = hop.replace("SELECT query_id, a.target", "SELECT f.query_id, a.target").replace(f"SELECT * FROM path{i} WHERE score >= -1", f"SELECT path{i}.* FROM path{i} JOIN own USING (query_id) WHERE score >= prune")
    return hop.replace("WHERE r.score IS NULL", "JOIN own o ON o.query_id = b.query_id WHERE r.score IS NULL").replace("<= 0)", "<= o.beam)")


_OWN = f"""own AS (SELECT item_id AS query_id, [1, 2][item_id % 2 + 1] AS hops, [4, 8, 24][item_id % 3 + 1] AS beam, [0.05::DOUBLE, 0.3, 0.45, 0.6, 0.1][item_id % 5 + 1] AS prune, [0.0::DOUBLE, 0.1, 0.2, 0.3][item_id % 4 + 1] AS importance FROM benchmark),
    {SEEDS}, reach0 AS (SELECT query_id, entity_id, greatest(0.01::DOUBLE, score) AS score, '' AS path, []::VARCHAR[] AS edges FROM seed),
    front0 AS (SELECT r.* FROM reach0 r JOIN own USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) <= beam), {_own_hop(1)}, {_own_hop(2)}"""
ORACLE["evaluate_requests"] = f"""WITH {GRAPH}, {_OWN}, {_fused(False, 1.0, 0.0, 0.0, "[0.0::DOUBLE, 0.1, 0.2, 0.3][c.query_id % 4 + 1]", 0.0)},
    top AS (SELECT query_id, turn_uid, row_number() OVER w AS rank FROM fused WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, turn_uid) QUALIFY row_number() OVER w <= 10)
    SELECT 'graph_only' AS profile, query_id AS example_id, rank, turn_uid, hops AS max_hops, beam AS beam_width, prune AS prune_threshold, importance AS importance_weight FROM top JOIN own USING (query_id)"""

# Vectors of entities: sums of turns' vectors in whole numbers of 2**-32.
_ENTITY_VECTORS = f"""{TURN_VECTORS}, mention AS (SELECT DISTINCT turn_uid, entity_id FROM men),
    ev_sum AS (SELECT entity_id, dim, sum(round(value * 4294967296.0::DOUBLE) * times)::DOUBLE AS s FROM mention JOIN mean ON mean.id = mention.turn_uid JOIN often USING (turn_uid) GROUP BY ALL),
    ev_n AS (SELECT entity_id, sum(times) AS n FROM mention JOIN often USING (turn_uid) GROUP BY ALL),
    ev_len AS (SELECT entity_id, sqrt(sum(s * s ORDER BY dim)) AS l FROM ev_sum GROUP BY ALL), ev AS (SELECT entity_id, dim, CASE WHEN l <= 1e-9 THEN s ELSE s / l END AS value FROM ev_sum JOIN ev_len USING (entity_id))"""
ORACLE["graph_entity_vectors"] = f"""WITH {MENTION}, {HALVES}, often AS (SELECT turn_uid, CASE WHEN m = 2 THEN 2 ELSE 1 END AS times FROM crc), {_ENTITY_VECTORS}
    SELECT entity_id, n::BIGINT AS n, dim, round(value, 6) AS value FROM ev JOIN ev_n USING (entity_id) WHERE round(value, 6) <> 0"""
_LIKE = f"""often AS (SELECT turn_uid, 1 AS times FROM turns), {_ENTITY_VECTORS}, {_vectors('bq', 'benchmark', 'item_id', 'text')},
    alike AS (SELECT item_id AS query_id, entity_id, greatest(0.0::DOUBLE, round(sum(q.value * e.value ORDER BY dim), 9)) AS alike FROM bq_vec q JOIN ev e USING (dim) GROUP BY ALL)"""
_LIKE_SEEDS = SEEDS.replace(
    "max(0.85::DOUBLE * CASE WHEN exact THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END) AS score FROM q_names JOIN few USING (name)",
    "max(0.85::DOUBLE * CASE WHEN exact THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END + 0.15::DOUBLE * coalesce(alike, 0.0)) AS score FROM q_names JOIN few USING (name) LEFT JOIN alike USING (query_id, entity_id)",
)


def _like_hop(i: int) -> str:
    hop = _hop(i, _SHIPPED.prune_threshold, _SHIPPED.beam_width).replace("a.edge_score * 0.85::DOUBLE", "a.edge_score * (0.85::DOUBLE + 0.15::DOUBLE * coalesce(alike, 0.0))")
    return hop.replace("SELECT query_id, a.target", "SELECT f.query_id, a.target").replace("ON a.source_entity_id = f.entity_id)", "ON a.source_entity_id = f.entity_id LEFT JOIN alike k ON k.query_id = f.query_id AND k.entity_id = a.target_entity_id)")


ORACLE["seeds_by_vectors"] = f"WITH {GRAPH}, {_LIKE}, {_LIKE_SEEDS} SELECT query_id, entity_id, canonical_name, round(score, 6) AS score, place FROM seed"
ORACLE["beam_by_vectors"] = f"""WITH {GRAPH}, {_LIKE}, {_LIKE_SEEDS}, reach0 AS (SELECT query_id, entity_id, greatest(0.01::DOUBLE, score) AS score, '' AS path, []::VARCHAR[] AS edges FROM seed),
    front0 AS (SELECT * FROM reach0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) <= {_SHIPPED.beam_width}), {_like_hop(1)}, {_like_hop(2)} SELECT query_id, entity_id, round(score, 6) AS score, path FROM reach2"""
ORACLE["embed_model"] = f"""WITH {TURNS}, {_chunks("turns", "turn_uid")}, lt AS (SELECT id, i, 'passage: ' || chunk AS t, unnest(range(26)) AS dim FROM chunk),
    ln AS (SELECT id, i, dim, (length(t) - length(replace(t, chr((97 + dim)::INT), '')))::DOUBLE AS v FROM lt), ll AS (SELECT id, i, sqrt(sum(v * v)) AS l FROM ln GROUP BY ALL),
    lu AS (SELECT id, i, dim, CASE WHEN l <= 1e-9 THEN v ELSE v / l END AS v FROM ln JOIN ll USING (id, i)), lm AS (SELECT id, dim, sum(v ORDER BY i) / count(*) AS v FROM lu GROUP BY ALL),
    lz AS (SELECT id, sqrt(sum(v * v ORDER BY dim)) AS l FROM lm GROUP BY ALL) SELECT id AS turn_uid, dim, round(CASE WHEN l <= 1e-9 THEN v ELSE v / l END, 6) AS value FROM lm JOIN lz USING (id) WHERE round(CASE WHEN l <= 1e-9 THEN v ELSE v / l END, 6) <> 0"""


# The stored index of names and the stored adjacency change no row.
ORACLE["query_seeds_indexed"] = ORACLE["query_seeds"]
ORACLE["beam_stored"] = ORACLE["beam_traversal"]


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
