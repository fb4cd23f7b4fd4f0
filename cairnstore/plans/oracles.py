"""DuckDB SQL for the registered queries, and the parameters both sides use."""

from __future__ import annotations

from ..functions.chunking import ChunkerParams, gear_table
from ..functions.parsing import RATE_LIMIT_SIGNS
from ..sources.tables import COMPACT_EVERY, SLICE
from .scenario import AVG, SEED, VOLUMES

# Parameters of the queries.
GEAR_LOW = (1 << 26) - 1
PIN, PINS, PUT_PIN = 7000, (100, 1000, 5000, 10_000), 500
PROJECTED = (0, 1 << 10, 1 << 20, 40 << 20, 63 << 20, 200 << 20)
DEAD_GATE = 0.02
LATER = 3600
SETTINGS = ((0.8, 86_400, False), (0.8, 86_400, True), (0.001, 60, False), (0.001, 10**9, False), (0.001, 10**9, True))
WINDOW = 900
STORE_VOLUMES = (("v0", 256 << 20), ("v1", 256 << 20), ("v2", 512 << 20))
TARGETS = ("v0", "v2", "v3")
TAG_KEY = b"name tags of the registered query"
SIZES = ("512k", "1m", "1048576", " 2K ", "16m", "17m", "1023", "1024", "0", "", "k", "-1", "1.5m", "1g", "64 k", "00004096", "99999999999999")
VOLUME_ARGS = ("v0=/data/v0", "v1=https://host/owner/v1.git?x=y", "=x", "v2=", "v3", "", "a=b=c")
URLS = (
    "https://host.example/owner/name.git",
    "https://host.example/group/owner/name/",
    "ssh://git@host.example/owner/name",
    "https://host.example/name",
    "owner/name",
    "",
)
ANSWERS = ("HTTP 429", "Too Many Requests", "You have exceeded a secondary rate limit", "fatal: not found", "", "RATE LIMIT exceeded")

FILES = """
docs AS (SELECT doc_id AS put_ord, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, hex(encode(coalesce(text, ''))) AS h FROM documents)
"""


def _cdc(source: str = FILES, texts: str = "docs", seed: int = SEED) -> str:
    """Chunks (name, idx, pos, len, h) of every file by the cut rule; to be put after WITH RECURSIVE.

    Each byte's hash over the last bits + 2 bytes is a sum over a window; positions that match a
    mask are lists for each file, and the recursion takes the next cut from them. Only positions
    within bits + 1 bytes of a chunk's minimum are hashed anew, from the minimum on.
    """
    p = ChunkerParams.from_avg(AVG)
    w = p.bits + 2
    hard, easy = p.masks
    gear = ", ".join(str(g & hard) for g in gear_table(seed))
    lags = " + ".join(f"coalesce(lag(g, {k}) OVER o, 0) * {1 << k}" for k in range(1, w))
    return f"""{source},
gear AS (SELECT [{gear}] AS t),
bytes AS (SELECT name, i, t[CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) + 1] AS g
  FROM (SELECT name, h, unnest(range(CAST(len(h) // 2 AS BIGINT))) AS i FROM {texts}), gear),
hashed AS (SELECT name, i, g, g + {lags} AS hash FROM bytes WINDOW o AS (PARTITION BY name ORDER BY i)),
marks AS (SELECT name, count(*) AS n, list(g ORDER BY i) AS g,
    coalesce(list(i ORDER BY i) FILTER (WHERE hash & {hard} = 0), []) AS hard,
    coalesce(list(i ORDER BY i) FILTER (WHERE hash & {easy} = 0), []) AS easy
  FROM hashed GROUP BY name),
cuts AS (
  SELECT name, CAST(-1 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS stop FROM marks
  UNION ALL
  SELECT c.name, c.idx + 1, c.stop, CAST(CASE WHEN m.n - c.stop <= {p.min_size} THEN m.n ELSE coalesce(
      list_min(list_concat(
        list_filter(range(c.stop + {p.min_size}, least(c.stop + {p.min_size + w - 1}, m.n, c.stop + {p.max_size})), lambda i:
          CAST(list_sum(list_transform(range(c.stop + {p.min_size}, i + 1), lambda q: m.g[q + 1] << (i - q))) AS BIGINT)
            & CASE WHEN i < c.stop + {p.avg_size} THEN {hard} ELSE {easy} END = 0),
        list_filter(m.hard, lambda i: i >= c.stop + {p.min_size + w - 1} AND i < least(c.stop + {p.avg_size}, m.n)),
        list_filter(m.easy, lambda i: i >= greatest(c.stop + {p.min_size + w - 1}, c.stop + {p.avg_size}) AND i < least(c.stop + {p.max_size}, m.n)))) + 1,
      least(m.n, c.stop + {p.max_size})) END AS BIGINT)
  FROM cuts c JOIN marks m USING (name) WHERE c.stop < m.n),
cdc AS (SELECT name, idx, pos, stop - pos AS len FROM cuts WHERE idx >= 0),
chunks AS (SELECT name, idx, pos, len, sha256(unhex(substr(h, 2 * pos + 1, 2 * len))) AS chunk_id FROM cdc JOIN {texts} USING (name))
"""


def _with_cdc(select: str) -> str:
    return f"WITH RECURSIVE {_cdc()} {select}"


_SLICES = f"""{FILES},
pieces AS (SELECT name, put_ord, i AS idx, substr(h, CAST({2 * SLICE} * i + 1 AS BIGINT), {2 * SLICE}) AS hx
  FROM (SELECT name, put_ord, h, unnest(range(CAST(ceil(len(h) / {2.0 * SLICE}) AS BIGINT))) AS i FROM docs)),
slices AS (SELECT name, put_ord, idx, CAST(len(hx) // 2 AS BIGINT) AS len, sha256(unhex(hx)) AS chunk_id FROM pieces)
"""


def _scenario() -> str:
    """The store of scenario.py: slices, first places, puts, the placement fold, segments, references, live references."""
    writable = [(v, t) for v, t, spare in VOLUMES if not spare]
    rooms = [f"r{k}" for k in range(len(writable))]
    most = f"greatest({', '.join('s.' + r for r in rooms)})"
    chosen = " ".join(f"WHEN s.r{k} = {most} THEN {k}" for k in range(len(writable)))
    left = ", ".join(f"CASE WHEN k = {k} THEN r{k} - bytes ELSE r{k} END" for k in range(len(writable)))
    names = " ".join(f"WHEN {k} THEN '{v}'" for k, (v, _) in enumerate(writable))
    start = ", ".join(f"CAST({t} AS BIGINT)" for _, t in writable)
    volumes = ", ".join(f"({k}, '{v}', {t}, {str(s).lower()})" for k, (v, t, s) in enumerate(VOLUMES))
    return f"""{_SLICES},
volumes AS (SELECT * FROM (VALUES {volumes}) t(ord, id, threshold, spare)),
firsts AS (SELECT chunk_id, put_ord, len FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY put_ord, idx) AS k FROM slices) WHERE k = 1),
puts AS (SELECT put_ord, CAST(sum(len) AS BIGINT) AS bytes FROM firsts GROUP BY put_ord),
queue AS MATERIALIZED (SELECT put_ord, bytes, row_number() OVER (ORDER BY put_ord) AS n FROM puts),
fold AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS put_ord, CAST(NULL AS BIGINT) AS bytes, CAST(NULL AS INTEGER) AS k, {", ".join(f"{e} AS {r}" for e, r in zip(start.split(", "), rooms, strict=True))}
  UNION ALL
  SELECT n, put_ord, bytes, k, {left} FROM (
    SELECT q.n, q.put_ord, q.bytes, {", ".join("s." + r for r in rooms)}, CASE WHEN q.bytes > {most} THEN NULL {chosen} END AS k
    FROM fold s JOIN queue q ON q.n = s.n + 1)),
plan AS MATERIALIZED (SELECT put_ord, bytes, CASE k {names} END AS vol FROM fold WHERE n > 0),
segments AS (SELECT vol, 's' || lpad(CAST(put_ord AS VARCHAR), 9, '0') AS seg, put_ord, bytes FROM plan WHERE vol IS NOT NULL),
store AS (SELECT vol, seg, chunk_id, len AS clen FROM firsts JOIN segments USING (put_ord)),
refs AS (SELECT name, idx, chunk_id AS id, slices.len, clen, vol, seg FROM slices JOIN store USING (chunk_id)),
live AS (SELECT * FROM refs WHERE name NOT IN (SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
used AS (SELECT id AS vol, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM volumes LEFT JOIN segments ON id = vol GROUP BY id),
owners AS (SELECT id, vol, clen FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name, idx) AS k FROM live) WHERE k = 1),
alive AS (SELECT vol, CAST(sum(clen) AS BIGINT) AS live FROM owners GROUP BY vol),
stats AS (SELECT id, bytes AS total, coalesce(live, 0) AS live, greatest(bytes - coalesce(live, 0), 0) AS dead, CAST(threshold AS BIGINT) AS threshold, spare,
    CASE WHEN bytes = 0 THEN 0.0 ELSE CAST(greatest(bytes - coalesce(live, 0), 0) AS DOUBLE) / bytes END AS dead_ratio,
    CAST(bytes AS DOUBLE) / threshold AS utilization
  FROM volumes JOIN used ON volumes.id = used.vol LEFT JOIN alive ON alive.vol = volumes.id),
livesets AS (SELECT vol, count(*) AS n, CAST(sum(clen) AS BIGINT) AS bytes FROM (SELECT DISTINCT vol, id, clen FROM live) GROUP BY vol),
rooms AS (SELECT ord, id, spare, threshold - bytes AS headroom FROM volumes JOIN used ON id = vol),
dests AS (SELECT l.vol, (SELECT id FROM rooms r WHERE r.headroom >= l.bytes AND r.id <> l.vol ORDER BY spare DESC, headroom DESC, ord LIMIT 1) AS dest FROM livesets l),
groups AS (SELECT vol, substr(id, 1, 4) AS g, sha256(string_agg(id, chr(10) ORDER BY id)) AS d FROM (SELECT DISTINCT vol, id FROM live) GROUP BY vol, substr(id, 1, 4)),
ids AS (SELECT vol, substr(sha256('compact' || chr(10) || vol || chr(10) || string_agg(d, chr(10) ORDER BY g)), 1, 32) AS seg FROM groups GROUP BY vol)
"""


def _with_store(select: str) -> str:
    return f"WITH RECURSIVE {_scenario()} {select}"


_LOG = f"""
log AS (SELECT version, ts, 'u' || CAST(user_id AS VARCHAR) AS name, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'put' END AS action,
    CAST(round(value * 100) AS BIGINT) AS sz,
    CASE WHEN version % {COMPACT_EVERY} = {COMPACT_EVERY // 2} THEN 'compact' WHEN version % 128 = 0 THEN 'checkpoint' ELSE 'delta' END AS kind
  FROM (SELECT *, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS version FROM events))
"""


def _with_log(select: str) -> str:
    return f"WITH {_LOG} {select}"


_STATE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS k FROM log WHERE version <= {pin}) WHERE k = 1 AND action = 'put'"


def _rows(values: tuple[str, ...], name: str) -> str:
    quoted = ", ".join("('" + v.replace("'", "''") + "')" for v in values)
    return f"(VALUES {quoted}) t({name})"


def _splitmix(seed: int) -> str:
    """The low bits of 256 outputs of the splitmix64 generator, in DuckDB's 128-bit integers."""
    word = "18446744073709551616::UHUGEINT"

    def times(shift: int, factor: int) -> str:
        return f"xor(z, z >> {shift}::UHUGEINT) * {factor}::UHUGEINT % {word}"

    return f"""WITH a AS (SELECT i, ({seed}::UHUGEINT + (i + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % {word} AS z FROM range(256) t(i)),
      b AS (SELECT i, {times(30, 0xBF58476D1CE4E5B9)} AS z FROM a), c AS (SELECT i, {times(27, 0x94D049BB133111EB)} AS z FROM b)
      SELECT CAST(i AS BIGINT) AS i, CAST(xor(z, z >> 31::UHUGEINT) % {GEAR_LOW + 1}::UHUGEINT AS BIGINT) AS g FROM c"""


_PATH = "substr(chunk_id, 1, 2) || '/' || substr(chunk_id, 3, 2) || '/' || chunk_id"
_SIZE = r"regexp_extract(trim(s), '^\+?0*([0-9]{1,12})\s*([kKmM]?)$', %d)"
_BYTES = f"CAST({_SIZE % 1} AS BIGINT) * CASE lower({_SIZE % 2}) WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 ELSE 1 END"
_REPO = r"regexp_extract(regexp_replace(regexp_replace(regexp_extract(url, '(?s)^.*?://[^/]*/(.*)$', 1), '/+$', ''), '(\.git)+$', ''), '(?s)([^/]+)/([^/]+)$', %d)"
_KEY = TAG_KEY.ljust(64, b"\0")
_SETTINGS = ", ".join(f"({p}, {i}, {str(f).lower()})" for p, i, f in SETTINGS)

SQL: dict[str, str] = {
    "file_scan": f"WITH {FILES} SELECT name, CAST(len(h) // 2 AS BIGINT) AS size, sha256(unhex(h)) AS file_hash FROM docs",
    "file_hash": "SELECT 'page-' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS name, sha256(coalesce(html, '')) AS file_hash FROM pages",
    "chunk_hash": f"WITH {_SLICES} SELECT name, idx, chunk_id FROM slices",
    "gear_table": _splitmix(SEED),
    "cdc_chunks": _with_cdc("SELECT name, idx, len FROM cdc"),
    "chunk_offsets": _with_cdc('SELECT name, idx, pos AS "offset", len FROM cdc'),
    "put_stats": _with_cdc(
        """SELECT name, count(chunk_id) AS total_chunks, count(chunk_id) FILTER (WHERE k = 1) AS new_chunks, count(chunk_id) FILTER (WHERE k > 1) AS deduped,
        CAST(coalesce(sum(len) FILTER (WHERE k = 1), 0) AS BIGINT) AS new_bytes, CAST(any_value(len(h) // 2) AS BIGINT) AS size
        FROM docs LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY name, idx) AS k FROM chunks) USING (name) GROUP BY name"""
    ),
    "dedup_ratio": _with_cdc(
        """SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_chunks, CAST(sum(n * len) AS BIGINT) AS bytes, CAST(sum(len) AS BIGINT) AS distinct_bytes
        FROM (SELECT chunk_id, count(*) AS n, min(len) AS len FROM chunks GROUP BY chunk_id)"""
    ),
    "new_chunks": _with_cdc(
        """SELECT chunk_id, name AS first_name, idx AS first_idx, len
        FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY name, idx) AS k FROM chunks) WHERE k = 1"""
    ),
    "get_reassemble": "SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, coalesce(text, '') AS content FROM documents",
    "verify_chunks": f"WITH {FILES} SELECT name, true AS ok FROM docs",
    "noop_reputs": "SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, coalesce(contains(text, chr(10)), false) AS committed FROM documents",
    "fanout_path": f"WITH {_SLICES} SELECT DISTINCT chunk_id, {_PATH} AS path FROM slices",
    "chunk_lookup": _with_store("SELECT vol, seg, chunk_id, clen FROM store WHERE chunk_id IN (SELECT chunk_id FROM slices)"),
    "chunk_presence": _with_store(
        f""", html AS (SELECT hex(encode(coalesce(html, ''))) AS h FROM pages),
        asked AS (SELECT sha256(unhex(substr(h, CAST({2 * SLICE} * i + 1 AS BIGINT), {2 * SLICE}))) AS chunk_id
          FROM (SELECT h, unnest(range(CAST(ceil(len(h) / {2.0 * SLICE}) AS BIGINT))) AS i FROM html) UNION SELECT id FROM live)
        SELECT chunk_id, chunk_id IN (SELECT chunk_id FROM store) AS present FROM asked"""
    ),
    "dangling_refs": _with_store("SELECT name, idx, id, vol, seg FROM live WHERE vol = 'v1'"),
    "segment_list": _with_store("SELECT DISTINCT vol, seg FROM store"),
    "segment_listing": _with_store(f"SELECT seg, {_PATH} AS path, clen AS bytes FROM store"),
    "ls": _with_store("SELECT name, CAST(sum(len) AS BIGINT) AS size, count(*) AS n_chunks FROM live GROUP BY name ORDER BY name"),
    "manifest_json": _with_store("SELECT name, count(*) AS n_chunks, true AS ok FROM live GROUP BY name"),
    "log_scan": _with_log("SELECT version, name, action, sz FROM log ORDER BY version DESC"),
    "log_tip": _with_log("SELECT max(version) AS version FROM log"),
    "namespace_at": _with_log(f"SELECT name, version, sz FROM ({_STATE.format(pin=PIN)})"),
    "snapshot_ls": _with_log(
        " UNION ALL ".join(
            f"SELECT CAST({p} AS BIGINT) AS pin, count(*) AS n_files, CAST(sum(sz) AS BIGINT) AS bytes FROM ({_STATE.format(pin=p)})" for p in PINS
        )
    ),
    "name_history": _with_log("SELECT name, version, lead(version) OVER (PARTITION BY name ORDER BY version) AS valid_to, action FROM log"),
    "checkpoint_versions": _with_log(
        """SELECT version, coalesce(lead(version) OVER (ORDER BY version) - 1, (SELECT max(version) FROM log)) - version AS tail_len
        FROM log WHERE kind = 'checkpoint'"""
    ),
    "txn_kind_counts": _with_log("SELECT CASE kind WHEN 'checkpoint' THEN kind ELSE 'other' END AS kind, count(*) AS n FROM log GROUP BY 1"),
    "compaction_count": _with_log("SELECT count(*) AS n FROM log WHERE kind = 'compact'"),
    "last_compaction_time": _with_log("SELECT max(epoch_us(ts) // 1000000) AS ts FROM log WHERE kind = 'compact'"),
    "seg_index_at": _with_store(f"SELECT vol, seg, bytes FROM segments WHERE put_ord <= {PUT_PIN} ORDER BY vol, seg"),
    "volume_used": _with_store("SELECT vol, bytes FROM used"),
    "volume_stats": _with_store("SELECT id, total, live, dead, threshold, spare, dead_ratio, utilization FROM stats"),
    "select_volume": _with_store(
        f"""SELECT CAST(p AS BIGINT) AS projected, (SELECT id FROM rooms WHERE NOT spare AND headroom >= p ORDER BY headroom DESC, ord LIMIT 1) AS vol
        FROM (VALUES {", ".join(f"({p})" for p in PROJECTED)}) t(p)"""
    ),
    "placement_plan": _with_store("SELECT put_ord, bytes, vol FROM plan"),
    "compact_gates": f"""WITH RECURSIVE {_scenario()}, {_LOG},
        facts AS (SELECT (SELECT max(utilization) FROM stats WHERE NOT spare) AS most,
          (SELECT max(epoch_us(ts) // 1000000) FROM log) + {LATER} - (SELECT max(epoch_us(ts) // 1000000) FROM log WHERE kind = 'compact') AS since)
        SELECT CAST(pressure AS DOUBLE) AS pressure, CAST(min_interval AS BIGINT) AS min_interval, most >= pressure AS under_pressure,
          coalesce(since >= min_interval, true) AS interval_ok, force, force OR (most >= pressure AND coalesce(since >= min_interval, true)) AS open
        FROM (VALUES {_SETTINGS}) t(pressure, min_interval, force), facts""",
    "compact_candidates": _with_store(f"SELECT id AS vol, dead_ratio FROM stats WHERE NOT spare AND total > 0 AND dead_ratio > {DEAD_GATE}"),
    "compact_live_set": _with_store("SELECT vol, n, bytes FROM livesets"),
    "files_touching_volume": _with_store("SELECT DISTINCT vol, name FROM live"),
    "select_compact_dest": _with_store("SELECT vol, dest FROM dests"),
    "compact_segment_id": _with_store("SELECT vol, seg FROM ids"),
    "compact_rewrite": _with_store(
        "SELECT DISTINCT dest, ids.seg, chunk_id, store.clen FROM live JOIN dests USING (vol) JOIN ids USING (vol) JOIN store ON store.vol = live.vol AND chunk_id = id WHERE dest IS NOT NULL"
    ),
    "repoint": _with_store(
        """SELECT name, idx, id, CASE vol WHEN 'v0' THEN 'v3' ELSE vol END AS vol, CASE vol WHEN 'v0' THEN 'moved' ELSE seg END AS seg
        FROM live WHERE name IN (SELECT name FROM live WHERE vol = 'v0')"""
    ),
    "compaction_conflict": _with_store(
        "SELECT vol, bool_or(id NOT IN (SELECT id FROM live)) AS conflict FROM refs WHERE vol IN (SELECT vol FROM live) GROUP BY vol"
    ),
    "orphans": _with_store(
        f"SELECT vol, seg FROM segments WHERE (SELECT max(put_ord) FROM segments) - put_ord >= {WINDOW} AND (vol, seg) NOT IN (SELECT (vol, seg) FROM live)"
    ),
    "mirror_missing": f"SELECT id AS vol FROM (VALUES {', '.join(f'({chr(39)}{v}{chr(39)})' for v, _, _ in VOLUMES)}) t(id) WHERE id NOT IN {TARGETS}",
    "mirror_diff": f"""WITH RECURSIVE {_scenario()}, {_LOG}
        SELECT 'segment' AS kind, 'volumes/' || vol || '/' || seg AS path FROM segments WHERE put_ord > {PUT_PIN}
        UNION ALL SELECT 'log', 'log/' || lpad(CAST(version AS VARCHAR), 20, '0') FROM log WHERE version > {PIN}""",
    "parse_chunk_size": f"""SELECT s, CASE WHEN b BETWEEN 1024 AND 16777216 THEN b END AS bytes
        FROM (SELECT s, CASE WHEN {_SIZE % 1} <> '' THEN {_BYTES} END AS b FROM {_rows(SIZES, "s")})""",
    "parse_volume_arg": f"""SELECT s, nullif(regexp_extract(s, '(?s)^([^=]+)=(.+)$', 1), '') AS id, nullif(regexp_extract(s, '(?s)^([^=]+)=(.+)$', 2), '') AS url
        FROM {_rows(VOLUME_ARGS, "s")}""",
    "url_owner_name": f"""SELECT url, nullif({_REPO % 1}, '') AS owner, nullif({_REPO % 2}, '') AS name
        FROM (SELECT DISTINCT url FROM pages UNION ALL SELECT * FROM {_rows(URLS, "url")})""",
    "base64": 'SELECT text AS "in", base64(encode(text)) AS out FROM benchmark',
    "hex_roundtrip": 'SELECT text AS "in", text AS out FROM benchmark',
    "rate_limit_classifier": f"""SELECT s, {" OR ".join(f"contains(lower(s), '{x}')" for x in RATE_LIMIT_SIGNS)} AS limited
        FROM (SELECT DISTINCT text AS s FROM conversations UNION ALL SELECT * FROM {_rows(ANSWERS, "s")})""",
    "hmac_tag": f"""WITH {FILES} SELECT name, sha256(unhex('{bytes(b ^ 0x5C for b in _KEY).hex()}'
        || sha256(unhex('{bytes(b ^ 0x36 for b in _KEY).hex()}' || hex(encode(name)))))) AS tag FROM docs""",
    "zstd_roundtrip": f"WITH {FILES} SELECT name, true AS ok FROM docs",
    "seal_roundtrip": f"WITH {FILES} SELECT name, true AS ok FROM docs",
    "seal_cardinality": _with_cdc("SELECT count(DISTINCT chunk_id) AS distinct_plain, count(DISTINCT chunk_id) AS distinct_sealed FROM chunks"),
    "tamper_detect": _with_cdc("SELECT count(*) AS tried, count(*) AS rejected FROM chunks"),
    "store_disjoint": "SELECT CAST(0 AS BIGINT) AS shared",
    "txn_decode": _with_store("SELECT DISTINCT name, true AS ok FROM live"),
}

# The store that is really written (stored.py): what its log says and what it gives back, from the tables alone.

_ALIVE = """
docs AS (SELECT doc_id, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, coalesce(text, '') AS t,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM documents),
pgs AS (SELECT 'page-' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS name, coalesce(html, '') AS t FROM pages)
"""
_KINDS = "(VALUES (0, 'delta'), (1, 'delta'), (2, 'checkpoint'), (3, 'compact'), (4, 'delta'), (5, 'checkpoint'), (6, 'delta')) k(v, kind)"
_LEFT = "SELECT name, t FROM docs WHERE doc_id % 3 <> 0 AND NOT toxic UNION ALL SELECT name, t FROM pgs"
_AT = """SELECT 0 AS v, t FROM docs WHERE doc_id % 3 = 0 UNION ALL SELECT 1, t FROM docs WHERE doc_id % 3 < 2
  UNION ALL SELECT u, t FROM docs, (VALUES (2), (3)) x(u) WHERE doc_id % 3 = 1 UNION ALL SELECT 4, t FROM docs WHERE doc_id % 3 > 0
  UNION ALL SELECT u, t FROM docs, (VALUES (5), (6)) x(u) WHERE doc_id % 3 > 0 AND NOT toxic UNION ALL SELECT 6, t FROM pgs"""
_SNAPSHOTS = f"""WITH {_ALIVE} SELECT CAST(v AS BIGINT) AS version, count(*) AS n_files, CAST(sum(octet_length(encode(t))) AS BIGINT) AS bytes
  FROM ({_AT}) GROUP BY v"""
_LOG_KINDS = f"SELECT CAST(v AS BIGINT) AS version, kind FROM {_KINDS}"
#: Chunks of documents (by thirds) and pages in the order of their puts, as a plain store cuts them.
_PUTS = (
    "WITH RECURSIVE "
    + _cdc(
        """docs AS (SELECT 'd' || doc_id AS name, hex(encode(coalesce(text, ''))) AS h, CAST(CASE doc_id % 3 WHEN 2 THEN 2 ELSE doc_id % 3 END AS BIGINT) AS put FROM documents
    UNION ALL SELECT 'p' || page_id, hex(encode(coalesce(html, ''))), 3 FROM pages)""",
        seed=0,
    )
    + """, cut AS (SELECT put, chunk_id, len FROM chunks JOIN docs USING (name)),
  known AS (SELECT put, chunk_id, min(len) AS len, count(*) AS n FROM cut GROUP BY put, chunk_id),
  gone AS (SELECT chunk_id FROM known WHERE put = 0 AND chunk_id NOT IN (SELECT chunk_id FROM known WHERE put = 1)),
  toxic AS (SELECT 'd' || doc_id AS name FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL),
  live2 AS (SELECT DISTINCT chunk_id FROM chunks JOIN docs USING (name) WHERE put IN (1, 2) AND name NOT IN (SELECT name FROM toxic)),
  fresh AS (SELECT put, chunk_id, len, CASE put WHEN 0 THEN true WHEN 1 THEN chunk_id NOT IN (SELECT chunk_id FROM known WHERE put = 0)
      WHEN 2 THEN chunk_id NOT IN (SELECT chunk_id FROM known WHERE put = 1) ELSE chunk_id NOT IN (SELECT chunk_id FROM live2) END AS new FROM known)
"""
)

SQL |= {
    "store_log": _LOG_KINDS,
    "store_tail": _LOG_KINDS,
    "store_snapshots": _SNAPSHOTS,
    "store_snapshots_sealed": _SNAPSHOTS,
    "store_get": f"WITH {_ALIVE} SELECT name, sha256(t) AS file_hash FROM ({_LEFT})",
    "store_mirror": f"WITH {_ALIVE} SELECT name, sha256(t) AS file_hash FROM ({_LEFT})",
    "store_put_stats": _PUTS
    + """, sizes AS (SELECT put, sum(len(h) // 2) AS size FROM docs GROUP BY put),
      counts AS (SELECT put, count(*) AS total FROM cut GROUP BY put),
      added AS (SELECT put, count(*) AS n, sum(len) AS bytes FROM fresh WHERE new GROUP BY put)
      SELECT put, total AS total_chunks, coalesce(n, 0) AS new_chunks, total - coalesce(n, 0) AS deduped, CAST(coalesce(bytes, 0) AS BIGINT) AS new_bytes, CAST(size AS BIGINT) AS size
      FROM sizes JOIN counts USING (put) LEFT JOIN added USING (put)""",
    # The first put's volume is emptied into the spare, the third put's goes where more room is: the emptied one.
    "store_seg_index": _PUTS
    + """SELECT vol, CAST(sum(len) AS BIGINT) AS bytes FROM (
      SELECT 'v2' AS vol, len FROM known WHERE put = 0 AND chunk_id IN (SELECT chunk_id FROM known WHERE put = 1)
      UNION ALL SELECT 'v1', len FROM fresh WHERE put = 1 AND new
      UNION ALL SELECT 'v0', len FROM fresh WHERE put = 2 AND new
      UNION ALL SELECT (SELECT CASE WHEN coalesce(sum(len) FILTER (WHERE put = 2), 0) <= coalesce(sum(len) FILTER (WHERE put = 1), 0) THEN 'v0' ELSE 'v1' END FROM fresh WHERE new),
        len FROM fresh WHERE put = 3 AND new) GROUP BY vol""",
    "store_segment_listing": _PUTS
    + f"""SELECT DISTINCT {_PATH} AS path, len AS bytes FROM (SELECT chunk_id, len FROM fresh WHERE new AND put > 0
      UNION SELECT chunk_id, len FROM known WHERE put = 0 AND chunk_id IN (SELECT chunk_id FROM known WHERE put = 1))""",
    "store_refusals": "SELECT * FROM (VALUES ('first', true), ('again', false), ('same', false), ('won', true), ('lost', false), ('second init refused', true)) t(what, yes)",
    "store_orphans_swept": f"WITH {_ALIVE} SELECT name, sha256(t) AS file_hash, CAST(1 AS BIGINT) AS swept FROM docs WHERE doc_id % 3 = 0",
    "store_ingest": f"WITH {_ALIVE} SELECT name, CAST(octet_length(encode(t)) AS BIGINT) AS size, sha256(t) AS file_hash FROM docs WHERE doc_id % 3 = 1",
    "store_config": "SELECT CAST(1024 AS BIGINT) AS avg_size, CAST(3 AS BIGINT) AS zstd_level, CAST(3 AS BIGINT) AS checkpoint_interval, true AS sealed, CAST(o AS BIGINT) AS ord, v AS volume, CAST(m * 1048576 AS BIGINT) AS threshold, o = 2 AS spare FROM (VALUES (0, 'v0', 256), (1, 'v1', 256), (2, 'v2', 512)) t(o, v, m)",
}
