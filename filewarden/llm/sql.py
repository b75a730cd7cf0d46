"""SQL equivalents for DuckDB, with their constants written out."""

OP1 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), win AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), twin AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twin) GROUP BY rid
), line AS (
  SELECT rid, row_number() OVER () AS lid, lw, line, len(lw) AS n, length(line) AS chars, list_unique(lw) AS nd,
    length(line) - length(regexp_replace(line, '[#*$%&|<>!~^={}\\]', '', 'g')) AS marks,
    length(line) - length(replace(line, '|', '')) AS bars
  FROM (SELECT rid, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
        FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d))
), piece AS (
  SELECT lid, count(*) AS pieces, count(*) FILTER (list_unique(lw[s + 1:s + 100]) * 5 <= 100) AS few
  FROM (SELECT lid, lw, unnest(list_transform(range(0, ceil(n / 100)::BIGINT), lambda i: least(i * 100, n - 100))) AS s
        FROM line WHERE n > 100) GROUP BY lid
), lwin AS (
  SELECT lid, i, array_to_string(lw[i:i + 7], ' ') AS g
  FROM (SELECT lid, lw, unnest(range(1, len(lw) - 6)) AS i FROM line WHERE n > 100 AND nd * 5 <= n)
), ltwin AS (
  SELECT lid, i FROM lwin QUALIFY count(*) OVER (PARTITION BY lid, g) > 1
), lrep AS (
  SELECT lid, count(DISTINCT p) AS again FROM (SELECT lid, unnest(range(i, i + 8)) AS p FROM ltwin) GROUP BY lid
), judged AS (
  SELECT *, n > 0 AND ((marks >= 5 AND marks * 100 >= chars * 10) OR (bars >= 3 AND bars * 5 >= n)
    OR (n <= 30 AND regexp_matches(line, '(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|javascript is disabled|click here|subscribe to our newsletter|lorem ipsum)'))
    OR (n >= 10 AND n <= 100 AND nd * 5 <= n)
    OR (n > 100 AND (few * 2 > pieces OR (nd * 5 <= n AND coalesce(again, 0) * 2 > n)))) AS failed
  FROM line LEFT JOIN piece USING (lid) LEFT JOIN lrep USING (lid)
), agg AS (
  SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup,
    count(*) FILTER (failed) AS bad, coalesce(sum(n) FILTER (failed), 0) AS lost
  FROM judged GROUP BY rid
), j AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(rep.n, 0) AS reps, dup, bad, lost
  FROM d JOIN agg USING (rid) LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  dup::BIGINT AS n_dup_lines, reps::BIGINT AS n_repeat_words,
  (n_words < 20 OR reps * 100 > n_words * 30) AS base_failed,
  (NOT (n_words < 20 OR reps * 100 > n_words * 30) AND lost * 100 <= n_words * 50) AS kept,
  bad::BIGINT AS n_failed_lines, lost::BIGINT AS n_lost_words
FROM j
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), c AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap,
    sum(source_size) OVER () AS everything FROM s
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM c
), f AS (
  SELECT arg_min(everything - capped, capped)::DOUBLE / arg_min(open_weight, capped) AS level FROM o
  WHERE cap >= (everything - capped)::DOUBLE / open_weight * weight
), t AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, level * weight), 0) AS target,
    ('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM o, f
), p AS (
  SELECT d.*, source_size, target, u,
    row_number() OVER (PARTITION BY d.source ORDER BY
      greatest(length(bin(size)) - 6, 0) * 64 + (size >> greatest(length(bin(size)) - 6, 0)), ((coalesce(doc_id, -1) % 1024) + 1024) % 1024, doc_id, size) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE size * least(3, floor(u + target * place / source_size) - floor(u + target * (place - 1) / source_size)) END::BIGINT AS taken
FROM p
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w, row_number() OVER () AS rid
  FROM documents
), p AS (
  SELECT rid, i - 1 AS i, CASE WHEN w[i:i + 3] = ['gnu', 'general', 'public', 'license'] THEN 'gpl'
      WHEN w[i:i + 1] = ['apache', 'license'] THEN 'apache' WHEN w[i:i + 1] = ['cc', 'by'] THEN 'cc-by'
      WHEN w[i:i + 1] = ['mit', 'license'] THEN 'mit' END AS label
  FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), b AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels
  FROM p WHERE label IS NOT NULL GROUP BY rid
), t(label, body) AS (VALUES
  ('agpl-header', 'this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details'),
  ('all-rights-reserved', 'all rights reserved'),
  ('apache-header', 'licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license'),
  ('apache-notice', 'licensed under the apache license version 2 0'),
  ('bsd-2-clause', 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage'),
  ('bsd-notice', 'redistribution and use in source and binary forms with or without modification are permitted'),
  ('boost', 'permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following'),
  ('cc-by-nc', 'licensed under cc by nc'),
  ('gpl-header', 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details'),
  ('gpl-notice', 'this work is licensed under the gnu general public license version'),
  ('isc', 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software'),
  ('lgpl-header', 'this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details'),
  ('mit-notice', 'released under the mit license'),
  ('mit-text', 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software'),
  ('mpl-header', 'this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0'),
  ('public-domain', 'this work is dedicated to the public domain'),
  ('unlicense', 'this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means'),
  ('zlib', 'this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution')
), tw AS (
  SELECT label, list_distinct(string_split(body, ' ')) AS t,
    greatest(16, 2 ** ceil(log2(2 * len(string_split(body, ' ')))))::BIGINT AS length FROM t
), k AS (
  SELECT rid, length, w[s:s + length - 1] AS block
  FROM (SELECT rid, w, length, unnest(range(1, greatest(len(w) - length // 2, 1) + 1, length // 2)) AS s
        FROM d, (SELECT DISTINCT length FROM tw))
), m AS (
  SELECT rid, label, len(list_intersect(t, block))::DOUBLE / len(t) AS score FROM k JOIN tw USING (length)
  WHERE len(list_intersect(t, block)) * 100 >= len(t) * 90
), f AS (
  SELECT rid, list(DISTINCT label) AS labels, max(score) AS score FROM m GROUP BY rid
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(f.labels, []))), ',') AS labels,
  CASE WHEN b.rid IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(f.score, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)
"""

OP3 = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM g
"""

OP6 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, sha256(role || chr(10) || text) AS place,
    regexp_replace(role, '(\\*)(<s>|</s>|\[INST\]|\[/INST\])', '\1\1\\\2', 'g') AS erole,
    regexp_replace(text, '(\\*)(<s>|</s>|\[INST\]|\[/INST\])', '\1\1\\\2', 'g') AS etext
  FROM t
), s AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, place) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, place) FILTER (role = 'assistant'), '') AS loss,
    sum(length(erole) + length(etext) + length('<s> [INST]  [/INST]</s>') + 1) AS chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM s
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents
), l0 AS (
  SELECT key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM (SELECT DISTINCT key, text FROM d)
), l1 AS (
  SELECT key, i, list_filter(regexp_split_to_array(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l0
), l2 AS (
  SELECT key, i, w, len(w) AS n, w[1:3] AS lead, sum(len(w)) OVER (PARTITION BY key) AS of_text,
    CASE WHEN len(w) >= 50 THEN 2 WHEN len(w) >= 20 THEN 3 WHEN len(w) >= 10 THEN 5 ELSE 10 END AS needed
  FROM l1
), hot AS (
  SELECT n, lead FROM l2 WHERE n >= 3 GROUP BY n, lead, needed HAVING count(*) >= needed
), f AS (
  SELECT l2.* FROM l2 JOIN hot USING (n, lead)
), u AS (
  SELECT w, n, lead, needed, count(DISTINCT key) AS docs FROM f GROUP BY w, n, lead, needed
), e AS (
  SELECT w, n, lead, needed, docs, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM u
), c AS (
  SELECT n, lead, place, word, sum(docs) AS docs FROM e WHERE word <> '<*>' GROUP BY n, lead, place, word
), m AS (
  SELECT e.w, e.n, e.lead, e.place, e.word, coalesce(c.docs, 0) >= 10 AS often, coalesce(c.docs, 0) >= e.needed AS enough
  FROM e LEFT JOIN c ON e.n = c.n AND e.lead = c.lead AND e.place = c.place AND e.word = c.word
), t AS (
  SELECT w, n, lead, list(CASE WHEN often THEN word ELSE '<*>' END ORDER BY place) AS template FROM m
  GROUP BY w, n, lead HAVING count(*) FILTER (often) * 100 >= n * 70
  UNION
  SELECT w, n, lead, list(CASE WHEN enough THEN word ELSE '<*>' END ORDER BY place) AS template FROM m
  GROUP BY w, n, lead HAVING count(*) FILTER (enough) * 100 >= n * 70
), s AS (
  SELECT key, i, f.n, of_text, (f.n, f.lead, template) AS template FROM f JOIN t ON f.w = t.w
), o AS (
  SELECT template, min(key) AS owner FROM s GROUP BY template
), lined AS (
  SELECT key, i, max(n) AS n, max(of_text) AS of_text, min(owner) AS owner, list(template) AS templates
  FROM s JOIN o USING (template) GROUP BY key, i
), tops AS (
  SELECT key, owner, sum(n) AS w FROM lined WHERE owner <> key GROUP BY key, owner
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY w DESC, owner DESC) <= 2
), hosts AS (
  SELECT template, key, sum(n) AS own, max(n) AS n, max(of_text) AS of_text, min(owner) AS owner
  FROM (SELECT key, n, of_text, owner, unnest(templates) AS template FROM lined) GROUP BY template, key
), best AS (
  SELECT h.template, h.key, h.n, h.of_text - h.own AS rest, max((t.w - CASE WHEN t.owner = h.owner THEN h.own ELSE 0 END, t.owner)) AS best
  FROM hosts h LEFT JOIN tops t ON h.key = t.key GROUP BY h.template, h.key, h.n, h.of_text, h.own
), cls AS (
  SELECT DISTINCT template, n, CASE WHEN rest <= 0 THEN 0 WHEN best[1] > 0 AND best[1] * 100 >= rest * 50 THEN best[2] ELSE key END AS cls
  FROM best
), r AS (
  SELECT template FROM cls GROUP BY template, n
  HAVING count(*) >= CASE WHEN n >= 50 THEN 2 WHEN n >= 20 THEN 3 WHEN n >= 10 THEN 5 ELSE 10 END
), g AS (
  SELECT DISTINCT key, i FROM s JOIN r USING (template)
), k AS (
  SELECT l0.key, count(*) AS n_lines, count(g.i) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY l0.i) FILTER (g.i IS NULL), '') AS kept
  FROM l0 LEFT JOIN g ON l0.key = g.key AND l0.i = g.i GROUP BY l0.key
)
SELECT d.doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN k USING (key)
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT rid, i, hash(w[i:i + 34]) AS h, w[i:i + 34] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), t AS (
  SELECT rid, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1) QUALIFY count(*) OVER (PARTITION BY g) > 1
), c AS (
  SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM t)
), k AS (
  SELECT e.rid, count(c.p) AS removed, coalesce(string_agg(word, ' ' ORDER BY e.p) FILTER (c.p IS NULL), '') AS kept
  FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) e LEFT JOIN c ON e.rid = c.rid AND e.p = c.p GROUP BY e.rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), q AS (
  SELECT row_number() OVER () AS qid, item_id, list_distinct(list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM benchmark
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0
), post AS (
  SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM post, total GROUP BY term, docs
), size AS (
  SELECT rid, doc_id, 10 + (90 * len(w)::BIGINT * docs) // words AS m FROM d, total WHERE len(w) > 0
), score AS (
  SELECT qid, item_id, rid, doc_id, sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM (SELECT qid, item_id, unnest(w) AS term FROM q) JOIN weight USING (term) JOIN post USING (term) JOIN size USING (rid)
  GROUP BY qid, item_id, rid, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM score WHERE score > 0
QUALIFY rank <= 10
"""

OP13 = r"""
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same,
    list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.rid <> b.rid AND len(a.v) = len(b.v)
), p AS (
  SELECT anchor, anchor_id, rid AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id, rid)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
