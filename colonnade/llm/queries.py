"""One query per corpus operator, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import alignment, conversations, exact_dedup, jaccard_join, language, licences, lm_scoring, near_vectors, packing, pieces, pii, secret_scan, token_files
from colonnade.llm.common import read, staged
from colonnade.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2, capacity=1024)


@query("op7_token_files")
def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=2)
    files = token_files.read_token_files(spark, path)
    found = token_files.with_starts(token_files.token_digests(files), files)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@query(
    "op9_exact_dedup",
    r"""with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents)
    select doc_id, min(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
           doc_id = min(doc_id) over (partition by t) kept, sha256(t) text_sha256 from d""",
)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def _secrets_sql() -> str:
    """The regexes searched directly, without any index: spans from the pieces between matches."""
    plain = {"access": ("AKIA[A-Z0-9]+", 20)}  # as the contract words it
    parts = []
    for n, rule in enumerate(secret_scan.RULES):
        pattern, least = plain.get(rule.kind, (rule.pattern, rule.least))
        quoted = pattern.replace("'", "''")
        parts.append(
            f"""select doc_id, {n} k, '{rule.kind}' kind, s.s s, s.e e from (select doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
            s := coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
            e := coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0),
            n := length(c[i])))) s
            from (select doc_id, regexp_extract_all(t, '{quoted}', 0) m, regexp_extract_all(t, '{quoted}', {rule.group}) c, string_split_regex(t, '{quoted}') g from d)) where s.n >= {least}"""
        )
    base = len(secret_scan.BASE)
    shown = "string_agg(kind || ':' || s || ':' || e, ',' order by s, k)"
    counts = ", ".join(f"count(*) filter (k = {n}) n_{r.kind}" for n, r in enumerate(secret_scan.BASE))
    outer = ", ".join(f"coalesce(n_{r.kind}, 0) n_{r.kind}" for r in secret_scan.BASE)
    return f"""with d as (select doc_id, coalesce(text, '') t from documents), x as (select doc_id, k, kind, cast(s as bigint) s, cast(e as bigint) e from ({" union all ".join(parts)})),
        y as (select doc_id, {counts}, {shown} filter (k < {base}) own, {shown} spans, count(*) filter (k >= {base}) n_added from x group by doc_id)
        select d.doc_id, {outer}, sha256(coalesce(own, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_added, 0) n_added from d left join y on d.doc_id = y.doc_id"""


@query("op10_secret_scan", _secrets_sql())
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(read(spark, sf_dir, "documents"))


@query(
    "op6_jaccard_join",
    r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
    s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
        when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) sh from w)),
    n as (select doc_id, count(*) n from s group by doc_id),
    shared as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
    links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
    reach(a, r) as (select doc_id, doc_id from documents union select reach.a, links.b from reach join links on reach.r = links.a)
    select reach.a doc_id, coalesce(any_value(n.n), 0) n_shingles, min(r) component_id from reach left join n on n.doc_id = reach.a group by reach.a""",
)
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.near_groups(read(spark, sf_dir, "documents"), words=3, percent=90)
    return groups.select("doc_id", "n_shingles", "component_id")


@query(
    "op2_embedding_dedup",
    """with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings where embedding is not null and label is not null),
    links as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
    reach(a, r) as (select vec_id, vec_id from embeddings union select reach.a, links.b from reach join links on reach.r = links.a),
    n as (select a, count(*) n from links group by a)
    select reach.a vec_id, coalesce(any_value(n.n), 0) n_links, min(r) component_id, min(r) = reach.a kept from reach left join n on n.a = reach.a group by reach.a""",
)
def near_vectors_of_a_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_groups(read(spark, sf_dir, "embeddings"), cosine=0.93)


@query("op5_language_id")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def _licences_sql(threshold: float) -> str:
    """All segments against all templates, without the search for needed terms."""
    vectors, rarity, unseen = licences.template_vectors()
    v = ", ".join(f"({i}, '{t}', {w!r}e0)" for i, t, w in vectors)
    r = ", ".join(f"('{t}', {w!r}e0)" for t, w in rarity.items())
    n = ", ".join(f"({i}, '{name}')" for i, (name, _) in enumerate(licences.TEMPLATES))
    return rf"""with v(template, term, w) as (values {v}), r(term, rarity) as (values {r}), names(template, licence) as (values {n}),
    f as (select doc_id, text, coalesce(source, 'none') || '/' || (doc_id // 1000) top, doc_id // 100 hundred from documents),
    p as (select doc_id, text, case when doc_id % 1000 = 0 then top || '/LICENSE' when doc_id % 100 = 0 then top || '/' || hundred || '/LICENSE' else top || '/' || hundred || '/' || doc_id || '.txt' end path from f),
    lines as (select distinct path, unnest(string_split(regexp_replace(lower(text), '([.;!?])[ 	
]+', '' || chr(10), 'g'), chr(10))) line from p),
    words as (select path, line, unnest(regexp_extract_all(line, '[a-z0-9]+')) term from lines),
    tf as (select path, line, words.term, count(*) * coalesce(any_value(rarity), {unseen!r}e0) w from words left join r on words.term = r.term group by all),
    norm as (select path, line, sqrt(sum(w * w)) n from tf group by all),
    dots as (select path, line, template, round(sum(tf.w * v.w), 12) dot from tf join v on tf.term = v.term group by all),
    best as (select path, template, round(dot / n, 6) c from (select *, row_number() over (partition by path, line order by dot desc, template) k from dots) join norm using (path, line) where k = 1),
    own as (select path, licence, c from (select *, row_number() over (partition by path order by c desc, template) k from best where c >= {threshold}) join names using (template) where k = 1),
    folders as (select regexp_replace(path, '/[^/]*$', '') folder, licence, c from own where path like '%/LICENSE'),
    up as (select doc_id, f.licence, f.c, row_number() over (partition by doc_id order by length(f.folder) desc, f.c desc, f.licence) k from p join folders f on starts_with(p.path, f.folder || '/'))
    select p.doc_id, p.path, coalesce(own.licence, up.licence) licence, coalesce(own.c, up.c) licence_cosine,
      case when own.licence is not null then 'own' when up.licence is not null then 'inherited' end licence_from
    from p left join own on p.path = own.path left join up on p.doc_id = up.doc_id and up.k = 1"""


@query("op4_licence_scan", _licences_sql(0.7))
def licences_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(licences.document_tree(read(spark, sf_dir, "documents")), threshold=0.7).drop("text")


@query("op8_piece_encoding")
def piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.scan_pii(docs, pii.learn(docs))


def _repairs_sql() -> str:
    """Damage, faults and the cheapest edits by a fold over each conversation's rows, state by state."""
    put = lambda item, cost, edit: f"{{'c': {item}.c + {cost}, 'a': {item}.a || '{edit}'}}"
    far = "{'c': 1000000000, 'a': ''}"
    insert = f"""list_transform([s], lambda s: list_transform([list_min([s[3], {put("s[1]", 3, "I")}, {put("s[2]", 3, "I")}, {put("s[4]", 3, "I")}])],
        lambda u: [s[1], s[2], u, list_min([s[4], {put("u", 3, "I")}])])[1])[1]"""
    keep = lambda frm, initial: f"case when r.f in (0, 3) and r.i = '{initial}' then {put(frm, 'r.p', 'K')} else {far} end"
    rerole = lambda frm: f"case when r.f in (0, 3) then {put(frm, '3 + r.p', 'R')} else {far} end"
    users = ", ".join(f"{keep(s, 'u')}, {rerole(s)}" for s in ("t[1]", "t[2]", "t[4]"))
    step = f"""list_transform([{insert}], lambda t: [{put("t[1]", 4, "D")}, list_min([{put("t[2]", 4, "D")}, {keep("t[1]", "s")}]),
        list_min([{put("t[3]", 4, "D")}, {users}]), list_min([{put("t[4]", 4, "D")}, {keep("t[3]", "a")}, {rerole("t[3]")}])])[1]"""
    due = "case when x.state = 2 then 3 else 2 end"
    # a repair walks its audit: the state, the rows used up, and the messages so far
    walk = f"""list_reduce(list_transform(string_split(audit, ''), lambda e: {{'e': e, 'state': 0, 'at': 0, 'out': []::varchar[]}}), lambda x, y: case y.e
        when '' then x when 'D' then {{'e': '', 'state': x.state, 'at': x.at + 1, 'out': x.out}}
        when 'K' then {{'e': '', 'state': case rows[x.at + 1].i when 's' then 1 when 'u' then 2 else 3 end, 'at': x.at + 1, 'out': list_append(x.out, rows[x.at + 1].role || ':' || rows[x.at + 1].text)}}
        else {{'e': '', 'state': {due}, 'at': x.at + case y.e when 'R' then 1 else 0 end,
               'out': list_append(x.out, case when x.state = 2 then 'assistant:' else 'user:' end || case y.e when 'R' then rows[x.at + 1].text else '' end)}} end,
        {{'e': '', 'state': 0, 'at': 0, 'out': []::varchar[]}}).out"""
    white = r"[\x20\x09-\x0D]+$"
    return f"""with table_of as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n)) crcs),
    keyed as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') t, xor(4294967295, list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint),
        lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint)) % 20 kind from conversations, table_of),
    damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(t, '[.!?]', '', 'g') else t end as text, unnest(range(case kind when 3 then 2 else 1 end)) copy from keyed where kind <> 0),
    placed as (select *, left(role, 1) i, regexp_replace(text, '{white}', '') tail, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) place from damaged),
    faulty as (select *, case when tail = '' then 1 when row_number() over (partition by conv_id, role, text order by place) > 1 then 2 when right(tail, 1) not in ('.', '!', '?') then 3 else 0 end f,
        lag(i) over (partition by conv_id order by place) before from placed),
    convs as (select conv_id, list({{'i': i, 'f': f, 'p': case f when 3 then 3 else 0 end, 'role': role, 'text': text}} order by place) as rows, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps,
        count(*) filter (f = 1) blank, count(*) filter (f = 2) duplicate, count(*) filter (f = 3) truncated, count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) illegal from faulty group by conv_id),
    best as (select *, list_reduce(list_transform(rows, lambda q: {{'r': q, 's': [{far}]}}), lambda x, y: {{'r': y.r, 's': list_transform([{{'s': x.s, 'r': y.r}}], lambda z: list_transform([z.s], lambda s: list_transform([z.r], lambda r: {step})[1])[1])[1]}},
        {{'r': {{'i': '', 'f': 0, 'p': 0, 'role': '', 'text': ''}}, 's': [{{'c': 0, 'a': ''}}, {far}, {far}, {far}]}}).s s from convs),
    done as (select * exclude (s), unnest([list_min([s[1], ({insert})[4]])], recursive := false) goal from best),
    audits as (select *, goal.c cost, goal.a audit from done)
    select o.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(cost, 0)::bigint cost,
      coalesce(audit, '') audit, sha256(coalesce(array_to_string({walk}, chr(10)), '')) repaired_sha256
    from (select distinct conv_id from conversations) o left join audits on o.conv_id is not distinct from audits.conv_id"""


@query("op11_conversation_repair", _repairs_sql())
def conversation_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(read(spark, sf_dir, "conversations"))
    return conversations.repair_digests(rows, staged(conversations.repair_plans(rows), "plans"))


@query("op12_tokenizer_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_lm_scoring")
def language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
