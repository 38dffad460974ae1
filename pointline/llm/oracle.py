"""The text queries in SQL, where SQL can express them on whole tables."""

ORACLE = {}

#: CRC-32 of the decimal text of an id: the polynomial's rule, bit by bit.
CRC32 = """xor(list_reduce([ascii(c) for c in string_split({0}::VARCHAR, '')],
    lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b::BIGINT)), 4294967295::BIGINT), 4294967295::BIGINT)"""

ORACLE["op13_merkle"] = f"""
WITH RECURSIVE said AS (
    SELECT doc_id, lang, text,
        coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
        || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
        coalesce({CRC32.format('doc_id')} % 3 = 0, false) AS changed
    FROM documents
), hashed AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(text)::VARCHAR || ':' || CASE WHEN changed
            THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS claim
    FROM said
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, coalesce('=' || lang, '-') AS tree FROM hashed
), low(level, tree, pos, digest) AS (
    SELECT 0, tree, pos, leaf FROM leaves
    UNION ALL
    SELECT any_value(level) + 1, tree, pos // 8, sha256(string_agg(digest, '' ORDER BY pos))
    FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) WHERE n > 1 GROUP BY tree, pos // 8
), tops AS (
    SELECT tree, max(level) AS height, arg_max(digest, level) AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM low GROUP BY tree
), high(level, pos, digest) AS (
    SELECT 0, pos, subroot FROM tops
    UNION ALL
    SELECT any_value(level) + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY pos // 8
), whole AS (SELECT max(level) AS height, arg_max(digest, level) AS root FROM high),
nodes AS (
    SELECT l.level, l.tree, l.pos, l.digest FROM low l JOIN tops t USING (tree) WHERE l.level < t.height
    UNION ALL
    SELECT t.height + h.level, t.tree, h.pos, h.digest FROM tops t JOIN high h ON t.pos // (8 ** h.level)::BIGINT // 8 = h.pos // 8 CROSS JOIN whole w WHERE h.level < w.height
), ways AS (
    SELECT l.tree, l.pos AS leaf_pos, level,
        CASE WHEN level < t.height THEN l.pos // (8 ** level)::BIGINT ELSE t.pos // (8 ** (level - t.height))::BIGINT END AS pos
    FROM leaves l JOIN tops t USING (tree) CROSS JOIN whole w CROSS JOIN generate_series(0, 60) g(level) WHERE level < t.height + w.height
), beside AS (
    SELECT y.tree, y.leaf_pos, y.level, coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < y.pos), '') AS lefts,
        coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > y.pos), '') AS rights
    FROM ways y JOIN nodes n ON n.tree = y.tree AND n.level = y.level AND n.pos // 8 = y.pos // 8 GROUP BY ALL
), proofs AS (
    SELECT tree, leaf_pos, sha256(string_agg(lefts || rights, '' ORDER BY level)) AS proof_sha256 FROM beside GROUP BY ALL
), folds(tree, leaf_pos, level, digest) AS (
    SELECT tree, pos, 0, claim FROM leaves
    UNION ALL
    SELECT f.tree, f.leaf_pos, f.level + 1, sha256(b.lefts || f.digest || b.rights)
    FROM folds f JOIN beside b ON b.tree = f.tree AND b.leaf_pos = f.leaf_pos AND b.level = f.level
), folded AS (SELECT tree, leaf_pos, arg_max(digest, level) AS folded_root FROM folds GROUP BY ALL)
SELECT l.doc_id, l.leaf, t.subroot, w.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = w.root AS verified
FROM leaves l JOIN tops t USING (tree) CROSS JOIN whole w JOIN folded f ON f.tree = l.tree AND f.leaf_pos = l.pos
LEFT JOIN proofs p ON p.tree = l.tree AND p.leaf_pos = l.pos
"""

TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""

ORACLE["op11_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS place, doc_id, text FROM documents),
items AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
posted AS (SELECT place, term, count(*) AS tf FROM (SELECT place, {TERMS} FROM docs) GROUP BY ALL),
sizes AS (SELECT place, sum(tf)::BIGINT AS n FROM posted GROUP BY place),
whole AS (SELECT count(*) AS documents, sum(n)::BIGINT AS length FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * max(w.documents) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM posted CROSS JOIN whole w GROUP BY term),
asked AS (SELECT item, term, count(*) AS times FROM (SELECT item, {TERMS} FROM items) GROUP BY ALL),
norms AS (SELECT place, 25 + (75 * n * w.documents) // w.length AS m FROM sizes CROSS JOIN whole w),
scored AS (
    SELECT item, place, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN posted USING (term) JOIN weights USING (term) JOIN norms USING (place) GROUP BY ALL
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
    FROM scored JOIN docs USING (place) JOIN items USING (item) WHERE score > 0
) SELECT * FROM ranked WHERE rank <= 10
"""
