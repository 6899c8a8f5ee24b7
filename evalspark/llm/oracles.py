"""Plain SQL for the queries that SQL can express on whole tables (DuckDB dialect)."""

SQL: dict[str, str] = {
    "op1_benchmark_decontamination": r"""
        with d as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from documents
        ), i as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from benchmark
        ), windows as (
            select distinct item_id, least(len(words), 10) as size, array_to_string(words[pos:pos + 9], ' ') as body
            from (select item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as pos from i where len(words) > 0)
        ), places as (
            select doc_id, size, unnest(range(1, len(words) - size + 2)) as pos, words
            from d join (select distinct size from windows) on len(words) >= size
        ), met as (
            select doc_id, places.size, pos, item_id from places join windows
            on places.size = windows.size and array_to_string(words[pos:pos + places.size - 1], ' ') = body
        ), hit as (
            select doc_id, count(*) as n_hit from (
                select distinct doc_id, unnest(range(pos, pos + size)) as pos from (select distinct doc_id, size, pos from met)
            ) group by doc_id
        ), items as (
            select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
            from (select distinct doc_id, item_id::varchar as item from met) group by doc_id
        )
        select d.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
            coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
            coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (doc_id) left join items using (doc_id)
    """,
    "op2_chat_formatting": r"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), w as (
            select *, contains(text, '<|im_start|>') or contains(text, '<|im_end|>') or regexp_matches(text, '<\\+\|')
                as conflict,
                length(role) + length('<|im_start|>') + length('<|im_end|>') + 2 as frame
            from t
        ), m as (
            select *, case when conflict then length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) else length(text) end as inner_chars
            from w
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
            sum(frame + inner_chars)::bigint as formatted_chars, true as identical
        from m group by conv_id
    """,
    "op3_substring_dedup": r"""
        with d as (
            select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
            from documents
        ), p as (
            select doc_id, unnest(range(1, len(words) - 18)) as pos, words from d where len(words) >= 20
        ), w as (
            select doc_id, pos, row_number() over (partition by array_to_string(words[pos:pos + 19], ' ') order by doc_id, pos) > 1 as later
            from p
        ), g as (
            select distinct doc_id, unnest(range(pos, pos + 20)) as pos from w where later
        ), marks as (
            select doc_id, list(pos order by pos) as gone, count(*) as n_removed,
                count(*) filter (where not joined) as n_spans
            from (select *, pos = lag(pos, 1, -1) over (partition by doc_id order by pos) + 1 as joined from g) group by doc_id
        ), words as (
            select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as pos from d
        ), kept as (
            select words.doc_id, string_agg(word, ' ' order by words.pos) as kept
            from words left join g on words.doc_id = g.doc_id and words.pos = g.pos where g.pos is null group by words.doc_id
        )
        select d.doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
            coalesce(n_spans, 0)::bigint as n_spans, sha256(coalesce(kept, '')) as kept_sha256
        from d left join marks using (doc_id) left join kept using (doc_id)
    """,
    "op4_url_filters": r"""
        with u as (
            select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages
        ), p as (
            select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
            from u
        ), rules(verdict, rule, host, path) as (
            values ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
                ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
        ), fits as (
            select p.page_id, max_by(rules.rule, length(rules.rule)) as rule, max_by(rules.verdict, length(rules.rule)) as verdict
            from p join rules on (p.host = rules.host or ends_with(p.host, '.' || rules.host)) and starts_with(p.path, rules.path)
            group by p.page_id
        )
        select p.page_id, p.host, p.path, fits.rule, coalesce(fits.verdict, 'allow') as verdict
        from p left join fits on p.page_id = fits.page_id
    """,
    "op7_quality_rules": r"""
        with d as (
            select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
            from documents
        ), w as (
            select doc_id, pos, count(*) over (partition by doc_id, array_to_string(words[pos:pos + 4], ' ')) > 1 as twice
            from (select doc_id, words, unnest(range(1, len(words) - 3)) as pos from d where len(words) > 4)
        ), r as (
            select doc_id, count(*) as n from (select distinct doc_id, unnest(range(pos, pos + 5)) as pos from w where twice) group by doc_id
        ), m as (
            select d.doc_id, len(words)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
                len(lines) as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
                length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_capitals, coalesce(r.n, 0)::bigint as n_repeat_words
            from d left join r using (doc_id)
        ), b as (
            select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m
        )
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            not (base_failed or 10 * n_symbols > n_words or (n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines)
                or word_chars < 2 * n_words or word_chars > 20 * n_words or 2 * n_capitals > word_chars) as kept
        from b
    """,
}

# The table of CRC-32 (reflected polynomial 0xEDB88320) and the checksum of a text by it.
CRC_TABLE = """
    crc_step as (
        select i, 0 as k, i as v from range(256) t(i)
        union all
        select i, k + 1, case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from crc_step where k < 8
    ), crc_table as (select list(v order by i) as crc from crc_step where k = 8)
"""


def crc32(text: str) -> str:
    """DuckDB expression, where ``crc_table`` is joined."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


SQL["op12_spelling_variants"] = f"""
    with recursive {CRC_TABLE}, runs as (
        select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
        from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) as run from documents)
        group by all
    ), marked as (
        select run, n, {crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from runs, crc_table where length(run) >= 6
    ), counted as (
        select case when h % 199 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, sum(n)::bigint as n
        from marked group by all
    ), words as (select word, n from counted where length(word) >= 6 and n >= 5
    ), cut as (
        select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest
        from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
    ), near as (
        select a.word, b.word as other, b.n as other_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
        union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
        union select b.word, a.word, a.n from cut a join words b on a.rest = b.word
    ), best as (
        select word, count(*) as n_near, (list(other order by other_n desc, encode(other)))[1] as other, max(other_n) as other_n from near group by word
    ), formed as (
        select word, words.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * words.n then other end as form,
            case when other_n >= 5 * words.n then other_n end as form_n
        from words left join best using (word)
    ), chain as (
        select word, word as root, form from formed
        union all
        select chain.word, formed.word, formed.form from chain join formed on chain.form = formed.word
    )
    select word, formed.form, root, n, n_near, form_n from formed join (select word, root from chain where form is null) using (word)
"""

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Edit strings are carried whole.
SQL["op13_conversation_repair"] = f"""
    with recursive {CRC_TABLE}, base as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
            {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind
        from conversations, crc_table
    ), hurt as (
        select conv_id, turn, case when kind = 4 then 'user' else role end as role,
            case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
        from base, range(case when kind = 3 then 2 else 1 end) where kind <> 0
    ), numbered as (
        select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
        from hurt
    ), placed as (
        select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again from numbered
    ), rows_ as (
        select conv_id, turn, i, role, text, left(role, 1) as c,
            case when body = '' then 1 when again then 2 when right(body, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
            lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair
        from placed
    ), stats as (
        select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum((fault = 1)::int) as blank,
            sum((fault = 2)::int) as duplicate, sum((fault = 3)::int) as truncated,
            sum((pair is not null and pair not in ('su', 'ua', 'au'))::int) as illegal, count(*) as last
        from rows_ group by conv_id
    ), ahead as (
        -- state before, insertions, state then, and the state after a row that is a user or an assistant in turn
        select * from (values (0, '', 0, 2, 'u'), (0, 'I', 2, 3, 'a'), (0, 'II', 3, 2, 'u'), (1, '', 1, 2, 'u'), (1, 'I', 2, 3, 'a'),
            (1, 'II', 3, 2, 'u'), (2, '', 2, 3, 'a'), (2, 'I', 3, 2, 'u'), (3, '', 3, 2, 'u'), (3, 'I', 2, 3, 'a')) t(q, ins, then_q, next_q, next_c)
    ), ways as (
        select conv_id, 0::bigint as i, 0 as q, {{'cost': 0::bigint, 'audit': ''}} as way from stats
        union all
        select conv_id, i, q, min(way) as way from (
            select r.conv_id, r.i, e.q, {{'cost': w.way.cost + 2 * length(a.ins) + e.price, 'audit': w.way.audit || a.ins || e.edit}} as way
            from ways w join rows_ r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1
            join ahead a on a.q = w.q,
            lateral (
                select a.then_q as q, 'D' as edit, 3 as price
                union all select a.next_q, 'K', case when r.fault = 3 then 1 else 0 end where r.fault in (0, 3) and r.c = a.next_c
                union all select 1, 'K', case when r.fault = 3 then 1 else 0 end where r.fault in (0, 3) and r.c = 's' and a.then_q = 0
                union all select a.next_q, 'R', case when r.fault = 3 then 3 else 2 end where r.fault in (0, 3)
            ) e
        ) group by conv_id, i, q
    ), ended as (
        select w.conv_id, min({{'cost': way.cost + 2 * length(fill), 'audit': way.audit || fill}}) as way
        from ways w join stats s on s.conv_id is not distinct from w.conv_id and s.last = w.i
        join (values (0, ''), (1, 'II'), (2, 'I'), (3, '')) f(q, fill) using (q) group by w.conv_id
    ), letters as (
        select conv_id, way.audit as audit, unnest(range(1, length(way.audit) + 1)) as k from ended
    ), read as (
        select conv_id, k, audit[k] as edit, length(replace(audit[:k], 'I', '')) as i, length(replace(audit[:k], 'D', '')) as said from letters
    ), headed as (
        select read.*, role, text, bool_or(said = 1 and edit = 'K' and role[1] = 's') over (partition by conv_id) as system
        from (select read.*, rows_.role, rows_.text from read left join rows_
            on rows_.conv_id is not distinct from read.conv_id and rows_.i = read.i and edit <> 'I') read
    ), said as (
        select conv_id, sha256(string_agg(
            case when edit = 'K' then role when (said + (case when system then 1 else 0 end)) % 2 = 1 then 'user' else 'assistant' end
            || ':' || case when edit = 'I' then '' else text end, chr(10) order by k)) as repaired_sha256
        from headed where edit <> 'D' group by conv_id
    ), ids as (select distinct conv_id from conversations)
    select ids.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
        coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(way.cost, 0)::bigint as cost,
        coalesce(way.audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
    from ids left join stats on ids.conv_id is not distinct from stats.conv_id
    left join ended on ids.conv_id is not distinct from ended.conv_id
    left join said on ids.conv_id is not distinct from said.conv_id
"""
