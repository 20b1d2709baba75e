"""DuckDB SQL for the queries that SQL can express, by brute force."""

from __future__ import annotations


def _shingles(table: str, key: str, width: int = 5) -> str:
    """Distinct word shingles of each text: (key, s)."""
    return rf"""
        select distinct {key}, unnest(case when len(ws) >= {width} then list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' '))
            when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as s
        from (select {key}, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as ws from {table}) t"""


#: Smallest node that links (a, b), given both ways, lead to.
REACH = """
    reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
    tops as (select a, least(a, min(b)) as top from reach group by a),
    n as (select a, count(*) as n from links group by a)"""

EMBEDDINGS = f"""
    with recursive v as (
        select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as (select p.vec_id as a, q.vec_id as b from v p join v q on p.label = q.label and p.vec_id <> q.vec_id and len(p.e) = len(q.e) where list_cosine_similarity(p.e, q.e) >= 0.98),
    {REACH}
    select vec_id, coalesce(n, 0) as n_links, coalesce(top, vec_id) as component_id, coalesce(top, vec_id) = vec_id as kept
    from embeddings left join n on n.a = vec_id left join tops on tops.a = vec_id"""


def urls(rules: list, default: str = "allow") -> str:
    values = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    return f"""
    with u as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end as rest from pages),
    h as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
    r(rh, rp, v) as (values {values})
    select page_id, host, path, rh || rp as rule, coalesce(v, '{default}') as verdict
    from h left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
    qualify row_number() over (partition by page_id order by length(rh || rp) desc) = 1"""


LEAKS = f"""
    with d as ({_shingles("documents", "doc_id")}), b as ({_shingles("benchmark", "item_id")}),
    q as (select item_id, count(*) as item_shingles from b group by item_id),
    m as (select doc_id, item_id, count(*) as matched from d join b using (s) group by doc_id, item_id)
    select doc_id, item_id, matched, item_shingles, matched / item_shingles as containment from m join q using (item_id) where matched >= 0.8 * item_shingles"""

JACCARD = f"""
    with recursive d as ({_shingles("documents", "doc_id")}),
    z as (select doc_id, count(*) as size, md5(string_agg(s, '|' order by s)) as digest from d group by doc_id),
    c as (select doc_id, min(doc_id) over (partition by digest) as class_id from z),
    k as (select p.doc_id as a, q.doc_id as b, count(*) as k from d p join d q on p.s = q.s and p.doc_id <> q.doc_id group by p.doc_id, q.doc_id),
    links as (select a, b from k join z x on x.doc_id = a join z y on y.doc_id = b where k / (x.size + y.size - k) >= 0.8),
    {REACH}
    select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(n, 0) as n_links, coalesce(top, doc_id) as component_id, coalesce(top, doc_id) = doc_id as kept
    from documents left join c using (doc_id) left join n on n.a = doc_id left join tops on tops.a = doc_id"""


#: One row with ``tab``, the table of CRC-32, and the checksum of an array of bytes by it.
CRC_TABLE = "tab as materialized (select list(v order by n) as tab from (select n, list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) t(n)) x)"


def _crc32(text: str) -> str:
    raw = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {raw}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _digest(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::bigint"


SHARDS = f"""
    with {CRC_TABLE},
    a as (select doc_id, source, coalesce(text, '') as text, {_digest("0", "coalesce(doc_id::varchar, '')", "coalesce(length(source) || ':' || source, '')", "coalesce(text, '')")} as key from documents),
    b as (select doc_id, source, octet_length(encode(text)) + 1 as size, {_crc32("text")} as crc, key, row_number() over (partition by key) - 1 as nth from a, tab),
    h as (select *, case when nth > 0 then {_digest("key", "nth")} else key end as hash from b),
    r as (select *, (row_number() over (partition by source order by hash, doc_id nulls first, crc, size) - 1 + {_digest("0", "'source'", "coalesce(length(source) || ':' || source, '')")}::double / 1152921504606846976.0::double) / count(*) over (partition by source) as part, count(*) over () as total from h),
    p as (select *, row_number() over (order by part, source nulls first, hash, doc_id nulls first, crc, size) - 1 as place from r)
    select doc_id, size::bigint as size, crc::bigint as text_crc32, 'rows' as law, (place * 16 // total)::int as shard, place - (place * 16 // total * total + 15) // 16 as slot, cast(null as int) as grown_shard from p"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ASSIGN = "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_TOKEN = "[A-Za-z0-9]{36}(?:[^A-Za-z0-9]|$)"
#: Kinds: expression, and what a match has to be. A checked token's match may end with the character after it.
_SECRETS = {
    "assign": (_ASSIGN, f"length(regexp_extract(s, '{_ASSIGN}', 2)) >= 6"),
    "access": ("AKIA[A-Z0-9]+", "length(s) >= 20"),
    "hex": ("[0-9a-f]+", "length(s) >= 24"),
    "github": (f"gh[pousr]_{_TOKEN}", "sum62 = crc"),
    "npm": (f"npm_{_TOKEN}", "sum62 = crc"),
}
_MATCHES = " union all ".join(f"select rid, {i} as no, '{kind}' as kind, regexp_extract_all(text, '{e}') as found, regexp_split_to_array(text, '{e}') as gaps from t where regexp_matches(text, '{e}')" for i, (kind, (e, _)) in enumerate(_SECRETS.items()))

SECRETS = f"""
    with {CRC_TABLE},
    t as (select doc_id, row_number() over () as rid, coalesce(text, '') as text from documents),
    m as ({_MATCHES}),
    u as (select rid, no, kind, unnest(found) as s, unnest(range(1, len(found) + 1)) as i, found, gaps from m),
    w as (select rid, no, kind, s, (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))::bigint as start,
        case when no > 2 then {_crc32("substr(s, 5, 30)")} end as crc,
        case when no > 2 then list_reduce(list_prepend(0::bigint, list_transform(string_split(substr(s, 35, 6), ''), lambda x: instr('{_BASE62}', x)::bigint - 1)), lambda a, b: a * 62 + b) end as sum62 from u, tab),
    f as (select rid, no, kind, start, start + case when no > 2 then 40 else length(s) end as stop from w
        where case kind {" ".join(f"when '{kind}' then {test}" for kind, (_, test) in _SECRETS.items())} end),
    g as (select rid, count(*) filter (where no = 0) as a, count(*) filter (where no = 1) as k, count(*) filter (where no = 2) as h,
        string_agg(kind || ':' || start || ':' || stop, ',' order by start, no) filter (where no < 3) as base, string_agg(kind || ':' || start || ':' || stop, ',' order by start, no) as whole from f group by rid)
    select doc_id, coalesce(a, 0) as n_assign, coalesce(k, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(whole, '') as spans from t left join g using (rid)"""

#: Quoted lines, passages, their digests, and sources by search; then replies by recursion.
QUOTATIONS = r"""
    with recursive line as (
        select conv_id, turn, i, line, case when regexp_matches(line, '^[ \t]*>') then len(regexp_extract(line, '^(?:[ \t]*>)+')) - len(replace(regexp_extract(line, '^(?:[ \t]*>)+'), '>', '')) else 0 end as level
        from (select conv_id, turn, unnest(w) as line, unnest(range(len(w))) as i from (select conv_id, turn, string_split(text, chr(10)) as w from conversations where text is not null) a) b),
    marked as (select *, lead(level, 1, 0) over p as after, coalesce(lag(level) over p, 0) as before from line window p as (partition by conv_id, turn order by i)),
    kept as (select *, level = 0 and not (after > 0 and regexp_matches(line, '(?i)^\s*(on|am|le|el)\b.*\b(wrote|schrieb|a écrit|escribió)\b[^\n]*:\s*$')) as own,
        cast(sum(case when level > 0 and level <> before then 1 else 0 end) over (partition by conv_id, turn order by i) as bigint) as place from marked),
    m as (select c.conv_id, c.turn, c.role, case when c.text is null or max(k.level) = 0 then c.text else coalesce(trim(string_agg(k.line, chr(10) order by k.i) filter (where k.own), E' \t\n\r\x0b\x0c'), '') end as own,
        coalesce(max(k.place), 0) as n_quotes from conversations c left join kept k using (conv_id, turn) group by c.conv_id, c.turn, c.role, c.text),
    part as (select conv_id, turn, unnest([own] || regexp_split_to_array(own, '\n[ \t]*\n') || string_split(own, chr(10))) as p from m where own is not null),
    passage as (select conv_id, turn, level, place, string_agg(regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', ''), chr(10) order by i) as p, count(*) as n from kept where level > 0 group by conv_id, turn, level, place),
    body as (select conv_id, turn, level, place, 0 as part, p from passage
        union all select conv_id, turn, level, place, 1, q from (select *, unnest(regexp_split_to_array(p, '\n[ \t]*\n')) as q from passage) x where q <> p and contains(trim(q, E' \t\n\r\x0b\x0c'), chr(10))
        union all select conv_id, turn, level, place, 2, unnest(string_split(p, chr(10))) from passage where n > 1),
    said as (select distinct conv_id, turn, trim(regexp_replace(lower(p), '[^\p{L}\p{N}]+', ' ', 'g')) as key from part),
    quote as (select conv_id, turn, level, place, part, trim(regexp_replace(lower(p), '[^\p{L}\p{N}]+', ' ', 'g')) as key from body),
    found as (select q.conv_id, q.turn, q.level, q.part, q.place,
        max(s.turn) filter (where s.conv_id = q.conv_id and s.turn < q.turn) as near, min((s.conv_id, s.turn)) as first, max(s.conv_id) as last_conv
        from quote q join said s on q.key = s.key and q.key <> '' group by q.conv_id, q.turn, q.level, q.part, q.place, q.key),
    common as (select conv_id, turn, count(*) as n_common from found where near is null and first[1] < conv_id and first[1] <> last_conv group by conv_id, turn),
    best as (select conv_id, turn, case when near is not null then (conv_id, near) else first end as up from found where near is not null or (first[1] < conv_id and first[1] = last_conv)
        qualify row_number() over (partition by conv_id, turn order by level, part, place) = 1),
    tree as (select conv_id, turn, cast(up[1] as bigint) as uc, cast(up[2] as bigint) as ut, cast(up[1] as bigint) as tc, cast(up[2] as bigint) as tt, cast(1 as bigint) as depth from best
        union all select t.conv_id, t.turn, t.uc, t.ut, cast(b.up[1] as bigint), cast(b.up[2] as bigint), t.depth + 1 from tree t join best b on b.conv_id = t.tc and b.turn = t.tt),
    top as (select * from tree qualify row_number() over (partition by conv_id, turn order by depth desc) = 1)
    select m.conv_id, m.turn, m.role, m.own as text, m.n_quotes, coalesce(n_common, 0) as n_common, uc as reply_conv, ut as reply_turn, coalesce(depth, 0) as depth, coalesce(tc, m.conv_id) as thread_conv,
    row_number() over (partition by coalesce(tc, m.conv_id) order by m.conv_id, m.turn, md5(coalesce(m.own, ''))) - 1 as position
    from m left join top using (conv_id, turn) left join common using (conv_id, turn)"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Near words by masks and by skipped code points; roots by recursion.
SPELLINGS = f"""
    with recursive {CRC_TABLE},
    r as (select coalesce(doc_id::varchar, '') as id, {_LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))")} as w from documents),
    k as (select id, w, count(*) as k from r where length(w) >= 7 group by id, w),
    h as (select w, k, {_crc32("id || ':' || w")} as h from k, tab),
    s as (select case when h % 31 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, k from h),
    v as materialized (select word, sum(k)::bigint as n from s where length(word) >= 7 group by word having sum(k) >= 2),
    m as materialized (select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b from (select word, n, unnest(range(1, length(word) + 1)) as i from v) x),
    near as (select x.word, y.word as other, y.n from m x join m y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
        union select m.word, v.word, v.n from m join v on v.word = m.a || m.b union select v.word, m.word, m.n from m join v on v.word = m.a || m.b),
    best as (select word, count(*) as n_near, max(n) as best_n from near group by word),
    pick as (select near.word, min(near.other) as best from near join best on near.word = best.word and near.n = best.best_n group by near.word),
    f as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * v.n then best end as form, case when best_n >= 10 * v.n then best_n end as form_n from v left join best using (word) left join pick using (word)),
    up as (select word, word as root, form as further from f union all select up.word, f.word, f.form from up join f on f.word = up.further)
    select f.word, f.form, up.root, f.n, f.n_near, f.form_n from f join up on up.word = f.word and up.further is null"""

_GRAMS = "ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) || list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])"

IMPORTANCE = f"""
    with {CRC_TABLE},
    w as materialized (select side, doc_id, row_number() over () as rid, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws
        from (select 's' as side, doc_id, text from documents union all select 't', null, text from benchmark) x),
    g as materialized (select side, rid, unnest({_GRAMS}) as f from w),
    c as materialized (select f, {_crc32("f")} % 10000 as b from (select distinct f from g) x, tab),
    e as materialized (select side, rid, b from g join c using (f)),
    n as (select count(*) filter (where side = 's')::double as s, count(*) filter (where side = 't')::double as t from e),
    gain as (select b, floor(1000 * ln((count(*) filter (where side = 't') + 1.0::double) * (any_value(n.s) + 10000) / ((count(*) filter (where side = 's') + 1.0::double) * (any_value(n.t) + 10000))))::bigint as gain from e, n group by b),
    d as (select rid, count(*) as n_features, sum(gain)::bigint as weight from e join gain using (b) where side = 's' group by rid),
    h as (select rid, doc_id, len(ws) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
        ('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from w left join d using (rid) where side = 's'),
    z as (select *, weight + floor(-1000.0::double * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from h),
    p as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls first, weight, n_features) as place, count(*) filter (where n_words >= 20) over () as able from z)
    select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 5 * able // 100 then place end as rank from p"""
