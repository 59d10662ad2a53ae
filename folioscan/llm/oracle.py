"""DuckDB statements for the registered queries that SQL can express."""

from __future__ import annotations

from folioscan.llm import credentials as cr, group_join as gj, spaced_seeds as ss


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def credentials() -> str:
    """Matches by what a pattern splits a text into; nearest candidates by window."""
    found = " UNION ALL ".join(
        f"""SELECT row, {rank} AS rank, gaps, whole, value, unnest(range(1, len(whole) + 1)) AS i, {kind.least} AS least, {kind.most} AS most
        FROM (SELECT row, string_split_regex(text, {_text(kind.pattern)}) AS gaps, regexp_extract_all(text, {_text(kind.pattern)}, 0) AS whole,
              regexp_extract_all(text, {_text(kind.pattern)}, {kind.group}) AS value
              FROM docs WHERE regexp_matches(text, {_text(kind.pattern)}))"""
        for rank, kind in enumerate(cr.KINDS))
    role = " ".join(f"WHEN {i} THEN '{k.role}'" for i, k in enumerate(cr.KINDS))
    name = " ".join(f"WHEN {i} THEN '{k.name}'" for i, k in enumerate(cr.KINDS))
    ends = " ".join(f"WHEN '{mine}' THEN max(CASE WHEN role = '{other}' THEN stop END) OVER before" for mine, other in cr.COMPLEMENT.items())
    starts = " ".join(f"WHEN '{mine}' THEN min(CASE WHEN role = '{other}' THEN start END) OVER after" for mine, other in cr.COMPLEMENT.items())
    spans = "coalesce(string_agg(span, ',' ORDER BY start, rank, stop) FILTER ({}), '')"
    counts = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{n}" for i, n in enumerate(cr.STRONG))
    return f"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({found}),
    spans AS (SELECT row, rank, start, start + length(whole[i]) AS stop FROM (
        SELECT *, coalesce(list_sum([length(g) for g in gaps[1:i]]), 0) + coalesce(list_sum([length(w) for w in whole[1:i-1]]), 0) AS start
        FROM found WHERE length(value[i]) BETWEEN least AND most)),
    roles AS (SELECT *, CASE rank {role} END AS role, rank < {len(cr.STRONG)} AS strong FROM spans),
    near AS (SELECT *, CASE role {ends} END AS end_before, CASE role {starts} END AS start_after,
        max(CASE WHEN strong THEN stop END) OVER before AS strong_before, min(CASE WHEN strong THEN start END) OVER after AS strong_after
        FROM roles WINDOW
        before AS (PARTITION BY row ORDER BY start, stop, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        after AS (PARTITION BY row ORDER BY start, stop, rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    kept AS (SELECT *, strong OR ((coalesce(start - end_before <= {cr.REACH}, false) OR coalesce(start_after - stop <= {cr.REACH}, false))
        AND NOT (coalesce(strong_before, -1) > start OR coalesce(strong_after, 2147483647) < stop)) AS kept,
        (CASE rank {name} END) || ':' || start || ':' || stop AS span FROM near)
    SELECT doc_id, {counts}, sha256({spans.format('strong')}) AS base_sha256, {spans.format('kept')} AS spans,
        count(*) FILTER (kept AND NOT strong) AS n_linked
    FROM docs LEFT JOIN kept USING (row) GROUP BY row, doc_id"""


def spaced_seeds() -> str:
    """The same definition, place by place.  Short items are compared at every
    place where one word of a fifth stands as in the item: no masks."""
    words = f"[w for w in string_split_regex(lower(coalesce(text, '')), {_text(ss.BREAKS)}) if w <> '']"

    def seeds(table: str, only: str = "true") -> str:
        seen = ", ".join(
            f"'{mask} ' || " + " || ' ' || ".join(f"words[spot + {k + 1}]" for k, c in enumerate(mask) if c == "1") for mask in ss.MASKS)
        return (f"SELECT *, unnest([{seen}]) AS seed FROM (SELECT *, unnest(range(0, len(words) - {ss.SPAN - 1})) AS spot FROM {table} "
                f"WHERE len(words) >= {ss.SPAN} AND {only})")

    return f"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {words} AS words FROM documents),
    items AS MATERIALIZED (SELECT DISTINCT item_id, {words} AS words FROM benchmark),
    short AS (SELECT * FROM items WHERE len(words) BETWEEN {ss.LEAST_WORDS} AND {ss.OVERLAP}),
    spots AS (SELECT row, doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS spot FROM docs),
    asked AS (SELECT item_id, words AS item, unnest(words) AS word, unnest(range(0, len(words))) AS spot FROM short),
    aligned AS (SELECT s.row, s.doc_id, a.item_id, a.item, s.spot - a.spot AS shift FROM spots s JOIN asked a USING (word)
        GROUP BY ALL HAVING count(*) >= {ss.SIMILAR} * len(a.item)),
    hits AS (SELECT DISTINCT d.doc_id, d.words, i.item_id, i.words AS item, least(len(i.words), {ss.OVERLAP}) AS n_words,
        greatest(0, least(i.spot + {ss.SPAN // 2 - ss.OVERLAP // 2}, len(i.words) - least(len(i.words), {ss.OVERLAP}))) AS low, d.spot - i.spot AS shift
        FROM ({seeds('docs')}) d JOIN ({seeds('items', f'len(words) > {ss.OVERLAP}')}) i USING (seed)
        UNION ALL SELECT a.doc_id, d.words, item_id, item, len(item), 0, shift FROM aligned a JOIN docs d USING (row)),
    same AS (SELECT doc_id, item_id, shift + low AS start, n_words,
        list_sum([CASE WHEN shift + low + k >= 0 AND words[greatest(0, shift + low + k) + 1] = item[low + k + 1] THEN 1 ELSE 0 END
                  for k in range(0, n_words)]) AS n_same FROM hits),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_same / n_words DESC, start, n_words DESC, n_same DESC) AS place FROM same)
    SELECT doc_id, item_id, CAST(start AS INT) AS start, CAST(n_words AS INT) AS n_words, CAST(n_same AS INT) AS n_same, n_same / n_words AS similarity
    FROM best WHERE place = 1 AND n_same / n_words >= {ss.SIMILAR}"""


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def group_join() -> str:
    """All pairs of documents that share a shingle, and what links reach."""
    width = gj.SHINGLE
    lower = LOWER.format("coalesce(text, '')")
    return f"""
    WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, CASE
            WHEN len(words) >= {width} THEN list_distinct([array_to_string(words[i:i + {width - 1}], ' ') for i in range(1, len(words) - {width - 2})])
            WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles
        FROM (SELECT doc_id, [w for w in string_split_regex({lower}, '[\\x20\\x09-\\x0D]+') if w <> ''] AS words FROM documents)),
    sets AS MATERIALIZED (SELECT row, len(shingles) AS n, unnest(shingles) AS shingle FROM docs),
    common AS MATERIALIZED (SELECT * FROM sets SEMI JOIN (SELECT shingle FROM sets GROUP BY shingle HAVING count(*) > 1) USING (shingle)),
    links AS MATERIALIZED (SELECT x.row AS a, y.row AS b FROM common x JOIN common y USING (shingle) WHERE x.row <> y.row
        GROUP BY x.row, y.row, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT d.doc_id, len(d.shingles) AS n_shingles, least(d.doc_id, min(o.doc_id)) AS component_id
    FROM docs d LEFT JOIN reach ON reach.a = d.row LEFT JOIN docs o ON o.row = reach.b GROUP BY d.row, d.doc_id, d.shingles"""


def _levels(name: str, key: str, leaves: str) -> str:
    """Every level of each key's tree, as a list of hashes."""
    return f"""{name} AS (SELECT {key}, 0 AS level, list(hash ORDER BY place) AS hashes FROM {leaves} GROUP BY {key}
        UNION ALL SELECT {key}, level + 1, [sha256(hashes[2 * i + 1] || coalesce(hashes[2 * i + 2], '')) for i in range(0, (len(hashes) + 1) // 2)]
        FROM {name} WHERE len(hashes) > 1)"""


def merkle_rollup() -> str:
    """Trees level by level as lists; siblings by their places."""
    def field(name: str, value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(count: str) -> str:
        return "sha256(" + " || ".join(field(c, count if c == "n_chars" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"

    crc = """xor(4294967295, list_reduce(list_concat([4294967295], [ascii(c) for c in string_split(CAST(doc_id AS VARCHAR), '')]),
        lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
    return f"""
    WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id, lang, {leaf('n_chars')} AS hash,
            CASE WHEN {crc} % 7 = 0 THEN {leaf('(n_chars::HUGEINT + 1)')} ELSE {leaf('n_chars')} END AS seen FROM documents),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, hash) - 1 AS place FROM leaves),
    {_levels('low', 'lang', 'placed')},
    subroots AS MATERIALIZED (SELECT 1 AS one, lang, hashes[1] AS hash, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM low WHERE len(hashes) = 1),
    {_levels('high', 'one', 'subroots')},
    ways AS (SELECT p.lang, p.doc_id, p.place, p.hash, p.seen, s.hash AS subroot, 0 AS tier, l.level, xor(p.place >> l.level, 1) AS beside, l.hashes
            FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN low l ON p.lang IS NOT DISTINCT FROM l.lang
        UNION ALL SELECT p.lang, p.doc_id, p.place, p.hash, p.seen, s.hash, 1, h.level, xor(s.place >> h.level, 1), h.hashes
            FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN high h ON true),
    steps AS (SELECT lang, doc_id, place, hash, seen, subroot, tier, level, len(hashes) AS n, hashes[beside + 1] AS sibling, beside % 2 = 0 AS before FROM ways),
    proofs AS (SELECT lang, doc_id, place, hash, seen, subroot,
            sha256(coalesce(string_agg(sibling, '' ORDER BY tier, level) FILTER (n > 1), '')) AS proof_sha256,
            coalesce(list((CASE WHEN before THEN 'L' ELSE 'R' END) || coalesce(sibling, '') ORDER BY tier, level) FILTER (n > 1), []) AS way
        FROM steps GROUP BY ALL_KEYS),
    folded AS (SELECT *, list_reduce(list_concat([seen], way), lambda own, step: sha256(
        CASE WHEN step[1] = 'L' THEN step[2:] || own ELSE own || step[2:] END)) AS folded_root FROM proofs)
    SELECT doc_id, hash AS leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
    FROM folded, (SELECT hashes[1] AS root FROM high WHERE len(hashes) = 1)""".replace("ALL_KEYS", "lang, doc_id, place, hash, seen, subroot")


def mask_ranking() -> str:
    """Every document's score for every item."""
    terms = "regexp_extract_all(" + LOWER.format("text") + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, terms, len(terms) AS n FROM (SELECT doc_id, {terms} AS terms FROM documents) WHERE len(terms) > 0),
    sums AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS all_terms FROM docs),
    asked AS MATERIALIZED (SELECT item, item_id, term, count(*) AS times FROM (
        SELECT row_number() OVER () AS item, item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL),
    held AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, n, unnest(terms) AS term FROM docs)
        SEMI JOIN asked USING (term) GROUP BY ALL),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, sums GROUP BY term),
    scores AS (SELECT item, item_id, doc, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // all_terms)))) AS BIGINT) AS score
        FROM asked JOIN held USING (term) JOIN weights USING (term), sums GROUP BY ALL),
    ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 10"""


STATEMENTS = {
    "op1_credentials": credentials(), "op4_spaced_seeds": spaced_seeds(), "op11_group_join": group_join(), "op12_merkle_rollup": merkle_rollup(),
    "op13_mask_ranking": mask_ranking()}
