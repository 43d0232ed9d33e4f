"""The same results in SQL for DuckDB, written from the definitions."""

from __future__ import annotations

from labmesh.llm import licences, urls


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def url_filter() -> str:
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    rules = ", ".join(f"({_text(rule)}, {_text(verdict)})" for rule, verdict in urls.RULES)
    return f"""
    WITH parts AS (
      SELECT page_id,
        CASE WHEN contains(url, '://')
          THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), {az}) ELSE '' END AS host,
        CASE WHEN contains(url, '://')
          THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
        list_distinct(regexp_split_to_array(translate(coalesce(url, ''), {az}), '[^a-z0-9]+'))
          AS words
      FROM pages
    ), rules(rule, verdict) AS (VALUES {rules}),
    hits AS (
      SELECT *, len(list_intersect(words, {_list(urls.STRICT)})) AS strict_hits,
        len(list_intersect(words, {_list(urls.SOFT)})) AS soft_hits
      FROM parts
    ), longest AS (
      SELECT host, path, arg_max(rule, length(rule)) AS rule,
        arg_max(rules.verdict, length(rule)) AS verdict
      FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
        ON ('.' || host) LIKE ('%.' || split_part(rule, '/', 1))
        AND starts_with(path, substr(rule, strpos(rule, '/')))
      GROUP BY host, path
    )
    SELECT page_id, host, path, rule,
      coalesce(verdict, CASE WHEN strict_hits > 0 OR soft_hits >= {urls.SOFT_HITS}
        THEN 'block' ELSE 'allow' END) AS verdict,
      CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits
    FROM hits LEFT JOIN longest USING (host, path)
    """


def _canonical(value: str) -> str:
    form = (
        f"translate(coalesce({value}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    )
    form = f"replace(replace({form}, '(c)', ' copyright '), chr(169), ' copyright ')"
    form = f"regexp_replace({form}, '[\\r\\n]+', chr(10), 'g')"
    signs = r"[\x00-\x09\x0B-/:-@\[-`{-\x{bf}\x{2010}-\x{206f}]+"
    form = f"regexp_replace({form}, {_text(signs)}, '  ', 'g')"
    form = f"'  ' || replace({form}, chr(10), '  ' || chr(10) || '  ') || '  '"
    for rare, usual in licences.SPELLINGS:
        rare, usual = rare.replace(" ", "  "), usual.replace(" ", "  ")
        form = f"replace({form}, ' {rare} ', ' {usual} ')"
    return f"regexp_replace({form}, ' +', ' ', 'g')"


_WHOLE = r"""trim(regexp_replace(regexp_replace(lines,
    '(^|\n) *copyright (copyright )?(by|[0-9]{4}) [^\n]*', chr(10), 'g'), '[ \n]+', ' ', 'g'))"""


def license_scan() -> str:
    known = ", ".join(
        f"({_text(name)}, {_text(text)})" for name, all in licences.KNOWN.items() for text in all
    )
    return f"""
    WITH known AS (
      SELECT sha256({_WHOLE}) AS digest, min(license) AS license
      FROM (SELECT license, {_canonical("text")} AS lines
            FROM (VALUES {known}) k(license, text)) GROUP BY ALL
    ), docs AS (
      SELECT row_number() OVER () AS n, doc_id, {_canonical("text")} AS lines FROM documents
    ), by_line AS (
      SELECT n, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses
      FROM (SELECT n, sha256(trim(unnest(string_split(lines, chr(10))))) AS digest FROM docs)
      JOIN known USING (digest) GROUP BY n
    ), whole AS (SELECT n, doc_id, sha256({_WHOLE}) AS digest FROM docs)
    SELECT doc_id, digest, license, coalesce(line_licenses, '') AS line_licenses
    FROM whole LEFT JOIN known USING (digest) LEFT JOIN by_line USING (n)
    """


def warc() -> str:
    return """
    WITH records AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
        sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), firsts AS (
      SELECT payload_digest, min(page_id) AS first FROM records
      WHERE payload_bytes >= 100 GROUP BY 1
    )
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id > first THEN first END AS refers_to
    FROM records LEFT JOIN firsts USING (payload_digest)
    """


def mixing() -> str:
    return r"""
    WITH sizes AS (
      SELECT doc_id, source, 
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        coalesce(w, 1.0) AS weight,
        (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17'), 1, 13))::BIGINT
          + 0.5) / 4503599627370496.0 AS u
      FROM documents LEFT JOIN (
        SELECT doc_id AS labelled, max(CASE quality WHEN 1 THEN 2.0 ELSE 0.5 END) AS w
        FROM labels WHERE quality IS NOT NULL GROUP BY 1) ON doc_id = labelled
    ), sources AS (
      SELECT source, sum(size)::BIGINT AS source_size,
        [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]
          ::DOUBLE AS w
      FROM sizes GROUP BY source
    ), levels AS (
      SELECT *, 3.0::DOUBLE * source_size AS ceiling,
        (sum(source_size) OVER ()::DOUBLE
          - coalesce(sum(3.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM sources WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, encode(source) NULLS LAST)
    ), targets AS (
      SELECT source, source_size, least(ceiling, max(level) OVER () * w) AS target FROM levels
    ), epochs AS (
      SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END
        ::BIGINT AS epochs FROM targets
    ), runs AS (
      SELECT doc_id, size, source_size, target, epochs,
        target - epochs * source_size AS budget,
        sum(size) OVER (PARTITION BY s.source ORDER BY -ln(u) / weight, doc_id NULLS FIRST, size
          ROWS UNBOUNDED PRECEDING) AS until
      FROM sizes s JOIN epochs e ON s.source IS NOT DISTINCT FROM e.source
    )
    SELECT doc_id, size, source_size, target,
      (size * (epochs + CASE WHEN epochs < 3 AND budget > 0 AND (until <= budget
        OR until - size < budget AND until - budget < budget - until + size) THEN 1 ELSE 0 END))
        ::BIGINT AS taken
    FROM runs
    """


def divergence() -> str:
    """Sources of a language compared over all its kept terms, and terms above the language's share."""
    share = "1 + (1000000000::HUGEINT * ({0} + 1)) // ({1} + v)"
    apart = "((p - q) * (p - q)) // q"
    return rf"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
words AS (
    SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM docs),
kept AS (
    SELECT lang, term, count(*) AS lang_count FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
langs AS (
    SELECT lang, count(*) AS v, sum(lang_count) AS lang_total FROM kept GROUP BY lang),
counts AS (
    SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
    SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(l.v, 0) AS v, l.lang_total
    FROM (SELECT DISTINCT lang, source FROM docs) g
    LEFT JOIN langs l USING (lang)
    LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) t USING (lang, source)),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share.format("coalesce(c.n, 0)", "g.total")} AS p,
           {share.format("k.lang_count", "g.lang_total")} AS q
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT lang, source, item, sum({apart}) AS value
        FROM (SELECT x.lang, x.source, y.source AS item, x.p, y.p AS q
              FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source)
        GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, {apart} AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""
