"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custspark.llm import (
    bpe,
    debruijn,
    disclosure,
    fertility,
    fim,
    fmindex,
    jaccard,
    ledger,
    lm,
    perspective,
    ring,
    skyband,
    warc,
)
from custspark.llm.common import table
from custspark.session import shared_folder

SHARDS = 16


def op1_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark passages; see fmindex.find."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fmindex.find(docs, table(spark, sf_dir, "benchmark"), ["doc_id"])
    return fmindex.digests(found).select(
        "row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op2_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and recurrent-model scores of whole texts; see lm.score."""
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and fertility bands of each document; see fertility.judge."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return fertility.judge(docs, ["doc_id", "lang"]).select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_tokens",
        "chars_per_token",
        "letters_per_token",
        "byte_share",
        "token_entropy",
        "band_failed",
    )


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, and what is read back from them; see warc.write and warc.read."""
    path = shared_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).select(
        F.col("page").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers").cast("bigint").alias("refers_to"),
    )


def op5_debruijn_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-word passages removed from later documents; see debruijn.remove."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = debruijn.remove(docs, ["doc_id"], texts=False)
    return removed.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op6_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each text and the text decoded from them, as digests; see bpe.digests."""
    return bpe.digests(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )


def op7_adaptive_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their 4-word shingles; see jaccard.join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.join(docs).select("doc_id", "n_shingles", "component_id")


def op8_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it; see disclosure.sanitise."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return disclosure.sanitise(docs, ["doc_id"], texts=False).select(
        "row.doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
        "n_terms",
    )


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from each speaker's perspective, its text as a digest; see perspective.rotate."""
    rendered = perspective.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    return rendered.select(
        "conv_id",
        "speaker",
        "block",
        "part",
        "n_turns",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.array_join(spans, ",").alias("mask"),
    )


def op10_consistent_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near-equal row counts; see ring.shard."""
    placed = ring.shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_counted_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle forms of every text, as digests; see fim.transform."""
    made = fim.transform(table(spark, sf_dir, "documents"), ["doc_id"])
    made = made.select("row.doc_id", "n", "form", "output", fim.parts(F.col("output"), F.col("form")).alias("parts"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("parts.prefix").cast("bigint").alias("prefix_chars"),
        F.length("parts.middle").cast("bigint").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("parts")).cast("binary"), 256).alias("restored_sha256"),
    )


def op12_dominance_skyband(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ; see skyband.audit."""
    return skyband.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, through a ledger that begins empty; see ledger.scan."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ledger.scan(docs, shared_folder(spark, "ledger"), ["doc_id"])
    joined = F.array_join(F.expr("transform(spans, s -> concat_ws(':', s.rule, s.start, s.end))"), ",")

    def number(rule: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("bigint").alias(f"n_{rule}")

    return found.select(
        "row.doc_id",
        *[number(r.name) for r in ledger.RULES],
        F.sha2(joined.cast("binary"), 256).alias("base_sha256"),
        joined.alias("spans"),
    )


QUERIES = {
    "op1_fm_index": op1_fm_index,
    "op2_gated_recurrent_lm": op2_gated_recurrent_lm,
    "op3_tokeniser_fertility": op3_tokeniser_fertility,
    "op4_warc_segments": op4_warc_segments,
    "op5_debruijn_compaction": op5_debruijn_compaction,
    "op6_chunked_bpe": op6_chunked_bpe,
    "op7_adaptive_jaccard": op7_adaptive_jaccard,
    "op8_disclosure": op8_disclosure,
    "op9_perspective_rotation": op9_perspective_rotation,
    "op10_consistent_hash_ring": op10_consistent_hash_ring,
    "op11_counted_infilling": op11_counted_infilling,
    "op12_dominance_skyband": op12_dominance_skyband,
    "op13_blob_ledger": op13_blob_ledger,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules for secrets in SQL (kind, pattern, group, least length).
_RULES = [
    (
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
        r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]
# Places of matches: the lengths of all that is between and in the matches before.
_MATCHES = """{name} as (
    select id, {kind} as kind, '{name}' as name, stop - length(hit) as start, stop
    from (
        select id, hit, part, cast(sum(length(gap) + length(hit)) over (partition by id order by i) as bigint) as stop
        from (
            select id, unnest(range(1, len(found) + 1)) as i, unnest(found) as hit, unnest(parts) as part, unnest(gaps[:len(found)]) as gap
            from (
                select id, regexp_extract_all(txt, '{pattern}') as found, regexp_extract_all(txt, '{pattern}', {grp}) as parts,
                    string_split_regex(txt, '{pattern}') as gaps
                from d
            )
        )
    )
    where length(part) >= {least}
)"""

ORACLE: dict[str, str] = {
    "op1_fm_index": rf"""
        with d as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from documents
        ),
        i as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from benchmark
        ),
        p as (select item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) as pos from i where len(words) > 0),
        w as (select distinct item_id, array_to_string(words[pos:pos + 9], ' ') as win, len(words[pos:pos + 9]) as n from p),
        sizes as (select distinct n from w),
        o as (select doc_id, words, unnest(range(1, len(words) + 1)) as pos from d),
        found as (
            select doc_id, pos, n, item_id
            from (select doc_id, pos, n, array_to_string(words[pos:pos + n - 1], ' ') as win
                from o, sizes where pos + n - 1 <= len(words)) join w using (win, n)
        ),
        hit as (
            select doc_id, count(distinct pos + k) as n_hit
            from (select distinct doc_id, pos, n, unnest(range(n)) as k from found) group by doc_id
        ),
        items as (
            select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
            from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
        )
        select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
            sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (doc_id) left join items using (doc_id)
    """,
    "op5_debruijn_compaction": r"""
        with d as (
            select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
        ),
        s as (select doc_id, words, unnest(range(1, len(words) - 48)) as pos from d where len(words) >= 50),
        w as (select doc_id, pos, array_to_string(words[pos:pos + 49], ' ') as win from s),
        f as (select doc_id, pos, min(doc_id) over (partition by win) as first from w),
        gone as (select distinct doc_id, pos + k as pos from (select doc_id, pos, unnest(range(50)) as k from f where first < doc_id)),
        o as (select doc_id, words, unnest(range(1, len(words) + 1)) as pos from d),
        kept as (
            select o.doc_id, string_agg(words[o.pos], ' ' order by o.pos) filter (g.pos is null) as txt, count(g.pos) as n
            from o left join gone g on o.doc_id = g.doc_id and o.pos = g.pos group by o.doc_id
        )
        select doc_id, cast(len(words) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(txt, '')) as kept_sha256
        from d left join kept using (doc_id)
    """,
    "op7_adaptive_jaccard": rf"""
        with recursive d as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as words
            from documents
        ),
        s as (
            select distinct doc_id, array_to_string(words[pos:pos + 3], ' ') as shingle
            from (select doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) as pos from d where len(words) > 0)
        ),
        n as (select doc_id, count(*) as n from s group by doc_id),
        shared as (
            select a.doc_id as a, b.doc_id as b, count(*) as met
            from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2
        ),
        links as (
            select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b
            where 100 * met >= 85 * (x.n + y.n - met)
        ),
        reach as (select doc_id, doc_id as other from d union select r.doc_id, l.b from reach r join links l on l.a = r.other)
        select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(other) as component_id
        from d join reach on reach.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
    """,
    "op4_warc_segments": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha1(html) as payload_digest from p),
        h as (select payload_digest, max(page_id) as head from d where payload_bytes >= 1000 group by payload_digest)
        select page_id, payload_bytes, payload_digest,
            case when page_id < head then 'revisit' else 'response' end as record_type,
            case when page_id < head then head end as refers_to
        from d left join h using (payload_digest)
    """,
    "op9_perspective_rotation": """
        with t as (
            select conv_id, turn, coalesce(role, 'unknown') as role,
                replace(coalesce(text, ''), '<|im_', '<| im_') as said,
                cast(coalesce(floor(turn / 64.0), -1) as bigint) as block
            from conversations
        ),
        n as (
            select *, row_number() over (partition by conv_id, block order by turn nulls first, role, said) as pos from t
        ),
        s as (select distinct conv_id, role as speaker from t where role <> 'system'),
        m as (
            select n.conv_id, speaker, block, cast((pos - 1) // 64 as bigint) as part, pos, role, said,
                case when role = 'system' then '<|im_start|>system' when role = speaker then '<|im_start|>assistant'
                    else '<|im_start|>user name=' || replace(translate(role, chr(10) || chr(13), '  '), '<|im_', '<| im_')
                    end || chr(10) as head
            from n join s on n.conv_id is not distinct from s.conv_id
        ),
        e as (
            select *, sum(length(head) + length(said) + 11) over (
                partition by conv_id, speaker, block, part order by pos rows unbounded preceding) as stop
            from m
        ),
        r as (
            select conv_id, speaker, block, part, count(*) as n_turns,
                string_agg(head || said || '<|im_end|>' || chr(10), '' order by pos) as txt,
                coalesce(string_agg(case when role = speaker then
                    cast(stop - length(said) - 11 as bigint) || ':' || cast(stop as bigint) end, ',' order by pos), '') as mask
            from e group by conv_id, speaker, block, part
        )
        select conv_id, speaker, block, part, n_turns, cast(length(txt) as bigint) as n_chars,
            sha256(txt) as text_sha256, mask
        from r
    """,
    "op11_counted_infilling": r"""
        with d as (
            select doc_id, coalesce(text, '') as txt, sha256('42:' || doc_id) as h,
                regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units
            from documents
        ),
        r as (
            select *, len(units) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
                cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
            from d
        ),
        c as (
            select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
                case when txt = '' or contains(txt, '<P>') or contains(txt, '<S>') or contains(txt, '<M>') or h3 % 100 >= 50
                    then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
            from r
        ),
        p as (
            select *, array_to_string(units[1:a], '') as pre, array_to_string(units[a + 1:b], '') as mid,
                array_to_string(units[b + 1:], '') as suf
            from c
        )
        select doc_id, cast(n as bigint) as n, form,
            case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars,
            case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
            sha256(case form when 'plain' then txt when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
                else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
            sha256(txt) as restored_sha256
        from p
    """,
    "op12_dominance_skyband": rf"""
        with d as (
            select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
            from documents
        ),
        w as (select id, lang, source, unnest(words) as term from d),
        kept as (select lang, term, count(*) as n_lang from w group by lang, term having count(distinct id) >= 30),
        c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
        l as (select lang, cast(count(*) as hugeint) as v, sum(n_lang) as total from kept group by lang),
        g as (
            select lang, source, coalesce(v, 0) as v, coalesce(total, 0) as total, coalesce(size, 0) as size
            from (select distinct lang, source from d) left join l using (lang)
                left join (select lang, source, sum(n) as size from c group by lang, source) using (lang, source)
        ),
        p as (
            select g.lang, g.source, kept.term, coalesce(c.n, 0) as n,
                cast(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.size + 5 * g.v) as bigint) as p,
                cast(1 + (1000000000::hugeint * (n_lang + 5)) // (g.total + 5 * g.v) as bigint) as q
            from g join kept using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term
        ),
        far as (
            select a.lang, a.source, b.source as item, cast(sum(abs(a.p - b.p)) as bigint) as value
            from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
        ),
        pairs as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
            from g a join g b on a.lang = b.lang and a.source <> b.source
                left join far on far.lang = a.lang and far.source = a.source and far.item = b.source
        ),
        parts as (select * from pairs union all select lang, source, 'term', term, p - q from p where n > 0 and p > q),
        ranked as (
            select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
            from parts
        )
        select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
    """,
    "op13_blob_ledger": f"""
        with d as (select row_number() over () as id, doc_id, coalesce(text, '') as txt from documents),
        {", ".join(_MATCHES.format(name=n, kind=k, pattern=p, grp=g, least=l) for k, (n, p, g, l) in enumerate(_RULES))},
        spans as (select * from assign union all select * from access union all select * from hex),
        done as (
            select id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
                string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) as spans
            from spans group by id
        )
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
            sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
        from d left join done using (id)
    """,
}
