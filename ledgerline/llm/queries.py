"""Registered queries of the operators over the test tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import ann, bpe, interactions, lattice, licences, lines, mixing, pages, sharding, simhash, toxicity, turns, urls
from ledgerline.llm.work import Scratch, importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, F.col("vec_id") % 20 == 0, Scratch(spark, "ann"))


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_copies(table(spark, sf_dir, "embeddings"), Scratch(spark, "lattice"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "mixing"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(docs, path, public_tokenizers.PATTERN)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(table(spark, sf_dir, "pages"), Scratch(spark, "pages"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), Scratch(spark, "urls"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.scores(docs, labels, Scratch(spark, "toxicity"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.cleaned(table(spark, sf_dir, "documents"), Scratch(spark, "lines"))
    return found.select("doc_id", "text", "lines_before", "lines_after")


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.conversation_audits(table(spark, sf_dir, "conversations"), Scratch(spark, "turns"))


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.document_licences(table(spark, sf_dir, "documents"))


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return interactions.document_filters(docs, labels, Scratch(spark, "interactions"))


QUERIES = {
    "op1_ann": op1_ann,
    "op2_lattice": op2_lattice,
    "op3_mixing": op3_mixing,
    "op4_bpe": op4_bpe,
    "op5_simhash": op5_simhash,
    "op6_pages": op6_pages,
    "op7_urls": op7_urls,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_line_dedup": op10_line_dedup,
    "op11_turns": op11_turns,
    "op12_licences": op12_licences,
    "op13_interactions": op13_interactions,
}


def _draw(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def _step(after: str, cost: int | str, edit: str) -> str:
    """The cost, as eight digits, and the edits of a walk, with one more edit ahead."""
    return f"(lpad(CAST(CAST(({after})[:8] AS BIGINT) + {cost} AS VARCHAR), 8, '0') || '{edit}' || ({after})[9:])"


_R = mixing.Recipe()

#: Expected results in SQL where it can state them; the others are held against plain versions in the tests.
ORACLES: dict[str, str] = {
    "op3_mixing": f"""
    WITH counted AS (
        SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
        FROM documents
    ), drawn AS (
        SELECT *, {_draw(f"'{_R.seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size")} AS draw FROM counted
    ), listed AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid
        FROM drawn GROUP BY source
    ), weighed AS (
        SELECT *, CAST([{", ".join(map(str, _R.weights))}][(sid - 1) % {len(_R.weights)} + 1] AS DOUBLE) AS weight,
            CAST(source_size AS DOUBLE) * {_R.most} AS cap, CAST(sum(source_size) OVER () AS BIGINT) * {_R.share}::DOUBLE AS goal
        FROM listed
    ), levels AS (
        SELECT *, cap / weight AS turn, (goal - coalesce(sum(cap) OVER earlier, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
        FROM weighed WINDOW earlier AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), aimed AS (
        SELECT *, least(cap, coalesce(max(level) FILTER (WHERE level < turn) OVER () * weight, cap)) AS target,
            {_R.block} AS block
        FROM levels
    ), quotients AS (
        SELECT sid, target / (2 * k + 1) AS quotient, k, CAST(round(goal / block) AS BIGINT) AS places
        FROM aimed, LATERAL (SELECT unnest(range(0, CAST(ceil(target / block) AS BIGINT) + 3)) AS k)
        WHERE target > 0
    ), seats AS (
        SELECT sid, [{", ".join(f"count(*) FILTER (place <= places * {i + 1} // {_R.shards})" for i in range(_R.shards))}] AS seats
        FROM (SELECT sid, places, row_number() OVER (ORDER BY quotient DESC, sid, k) AS place FROM quotients)
        GROUP BY sid
    ), sized AS (
        SELECT aimed.*, coalesce(seats, [{", ".join("0" * _R.shards)}]) AS seats,
            CAST(greatest(1, ceil(source_size / block)) AS BIGINT) AS n FROM aimed LEFT JOIN seats USING (sid)
    ), dealt AS (
        SELECT *, list_transform(seats, lambda s: least(s, {_R.most} * n)) AS ends,
            {_draw(f"'{_R.seed}:' || sid")} % n AS shift,
            CASE WHEN n % {mixing.STRIDE} = 0 THEN 1 ELSE {mixing.STRIDE} END AS stride
        FROM sized
    ), placed AS (
        SELECT doc_id, size, dealt.* EXCLUDE (source), CAST(coalesce(sum(size) OVER (PARTITION BY sid
            ORDER BY draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM drawn JOIN dealt ON drawn.source IS NOT DISTINCT FROM dealt.source
    ), taken AS (
        SELECT doc_id, size, source_size, target, list_transform(ends, lambda e: CAST(CASE WHEN size > 0 THEN
            list_sum(list_transform(range(start // block, (start + size - 1) // block + 1),
                lambda b: (least(size, (b + 1) * block - start) - greatest(0, b * block - start))
                    * ((e - (b * stride + shift) % n + n - 1) // n))) ELSE 0 END AS BIGINT)) AS sofar
        FROM placed
    )
    SELECT doc_id, size, source_size, target, sofar[-1] AS taken, array_to_string(list_transform(sofar,
        lambda w, i: w - CASE WHEN i = 1 THEN 0 ELSE sofar[i - 1] END), ',') AS shard_words
    FROM taken""",
    "op11_turns": f"""
    WITH RECURSIVE crc AS (
        SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
            lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
    ), drawn AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ')
                || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda c, b: xor(c // 256, crc[xor(c, b) % 256 + 1])), 4294967295) % 20 AS draw
        FROM conversations, crc
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
            CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM drawn, LATERAL (SELECT unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy)
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
    ), faulty AS (
        SELECT conv_id, turn, role, text, i, coalesce(role[1], '') AS initial, CASE
            WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?')
            THEN 'truncated' ELSE '' END AS fault,
            lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
        FROM placed
    ), counted AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
            count(*) FILTER (WHERE fault = 'truncated') AS truncated,
            count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
        FROM faulty GROUP BY conv_id
    ), walk AS (  -- from the last row back: cost (8 digits) and edits by what stands before: nothing, system, user, assistant
        SELECT conv_id, n AS i, '00000000' AS nothing, '00000010II' AS system, '00000005I' AS usr, '00000000' AS asst
        FROM counted
        UNION ALL
        SELECT conv_id, i, least(nothing, by_user) AS nothing, least(system, by_user) AS system,
            least(usr, by_assistant) AS usr, least(asst, by_user) AS asst
        FROM (SELECT *, {_step("least(usr, " + _step("asst", 5, "I") + ")", 5, "I")} AS by_user,
            {_step("least(asst, " + _step("usr", 5, "I") + ")", 5, "I")} AS by_assistant
        FROM (SELECT w.conv_id, w.i - 1 AS i,
                least({_step("w.nothing", 2, "D")}, CASE WHEN NOT forced AND initial = 's' THEN {_step("w.system", "extra", "K")}
                    ELSE '~' END, to_user) AS nothing,
                least({_step("w.system", 2, "D")}, to_user) AS system,
                least({_step("w.usr", 2, "D")}, CASE WHEN forced THEN '~' WHEN initial = 'a' THEN
                    {_step("w.asst", "extra", "K")} ELSE {_step("w.asst", "extra + 1", "R")} END) AS usr,
                least({_step("w.asst", 2, "D")}, to_user) AS asst
            FROM (SELECT w.*, f.initial, f.fault IN ('blank', 'duplicate') AS forced,
                    CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra,
                    CASE WHEN f.fault IN ('blank', 'duplicate') THEN '~' WHEN f.initial = 'u' THEN
                    {_step("w.usr", "extra", "K")} ELSE {_step("w.usr", "extra + 1", "R")} END AS to_user
                FROM walk w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.i) w))
    ), cheapest AS (
        SELECT conv_id, CAST(nothing[:8] AS BIGINT) AS cost, nothing[9:] AS audit FROM walk WHERE i = 0
    ), edits AS (
        SELECT conv_id, edit, k,
            count(*) FILTER (WHERE edit <> 'I') OVER upto AS i, count(*) FILTER (WHERE edit <> 'D') OVER upto AS p
        FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS k
            FROM cheapest WHERE audit <> '')
        WINDOW upto AS (PARTITION BY conv_id ORDER BY k)
    ), kept AS (
        SELECT e.conv_id, e.p, e.edit, f.role, f.text,
            max(CASE WHEN e.p = 1 AND e.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS s
        FROM edits e LEFT JOIN faulty f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.i = f.i
        WHERE e.edit <> 'D'
    ), whole AS (
        SELECT conv_id, sha256(string_agg(CASE edit WHEN 'K' THEN role
            ELSE CASE WHEN (p - s) % 2 = 1 THEN 'user' ELSE 'assistant' END END
            || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS digest
        FROM kept GROUP BY conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
        coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN cheapest h ON o.conv_id IS NOT DISTINCT FROM h.conv_id
    LEFT JOIN whole w ON o.conv_id IS NOT DISTINCT FROM w.conv_id""",
    "op13_interactions": """
    WITH texts AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
    ), firsts AS (
        SELECT text, min(doc_id) AS first FROM texts GROUP BY text
    ), counted AS (
        SELECT doc_id, part, text, first, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
            length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals
        FROM texts JOIN firsts USING (text)
    ), known AS (
        SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic
        FROM labels GROUP BY doc_id
    ), failing AS (
        SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
            CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
            || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
            || CASE WHEN 100 * capitals > 3 * length(text) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
            || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
        FROM counted LEFT JOIN known USING (doc_id)
    ), letters AS (
        SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
    ), orders AS (
        SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
    ), steps AS (
        SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS filter, filter_order[:step - 1] AS before
        FROM orders, (SELECT unnest(range(1, 6)) AS step)
    ), grouped AS (
        SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
        FROM failing GROUP BY part, fails
    ), played AS (
        SELECT part, filter_order, step, filter, n, good, toxic, fails,
            contains(fails, filter) AS hit, length(translate(fails, before, '')) < length(fails) AS gone
        FROM grouped, steps
    ), summed AS (
        SELECT part, filter_order, step, filter,
            CAST(coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0) AS BIGINT) AS kept,
            CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS removed,
            CAST(coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS BIGINT) AS redundant,
            CAST(coalesce(sum(n) FILTER (WHERE fails = filter), 0) AS BIGINT) AS unique_fails,
            CAST(coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS good_lost,
            CAST(coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS toxic_lost
        FROM played GROUP BY ALL
    )
    SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM summed""",
}
