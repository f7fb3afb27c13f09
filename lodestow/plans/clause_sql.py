"""The rules for packaging rows, container codes and masses as DuckDB states them, word by word, from the same fixed tables."""

from __future__ import annotations

from collections.abc import Iterable

from ..operators import clauses, gates, passages


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(xs: Iterable[str]) -> str:
    return ", ".join(quoted(x) for x in xs)


def word_classes(field: str) -> str:
    """The words of a cell as letters of their classes."""
    text = f"coalesce({field}, '')"
    for written, word in gates.UNSPLIT.items():
        text = f"regexp_replace({text}, '(?i){written}', ' {word} ', 'g')"
    by_class: dict[str, list[str]] = {}
    for word, letter in gates.WORDS.items():
        by_class.setdefault(letter, []).extend(gates.spellings(word))
    case = " ".join(f"WHEN w IN ({listed(words)}) THEN '{c}'" for c, words in by_class.items())
    found = "[a-z''’]+|[0-9]+|[^\\sa-z0-9''’\\-‐–]"
    letters = f"array_to_string(list_transform(regexp_extract_all(lower({text}), '{found}'), lambda w: CASE {case} WHEN regexp_matches(w, '^[a-z''’0-9一-鿿]') THEN 'w' ELSE 'p' END), '')"
    for name, letter in gates.NAMES:
        letters = f"regexp_replace({letters}, '{name}', '{letter}', 'g')"
    return letters


def packaging(table: str, columns: str, field: str) -> str:
    own = "names"
    for pattern, letter in gates.CARRIED:
        own = f"regexp_replace({own}, '{pattern}', '{letter}', 'g')"
    return f"SELECT {columns} FROM (SELECT *, {word_classes(field)} AS names FROM {table}) WHERE contains(names, 'E') AND NOT regexp_matches({own}, '[CU]')"


def _marked(clause: str) -> str:
    """The clause with its spelled kinds as marked codes."""
    for (a, b), kind in passages.SPELLED.items():
        clause = f"regexp_replace({clause}, '(?i)(^|[^A-Za-z]){a}[\\s-]?{b}([^A-Za-z]|$)', '\\1 §{kind} \\2', 'g')"
    for name, kind in passages.CJK_KINDS.items():
        clause = f"regexp_replace({clause}, '{name}(柜|集装箱)', ' ¤{kind} ', 'g')"
    return clause


def container_codes(table: str, key: str, clause: str) -> str:
    """(key, code), each code of a clause once."""
    kind = "CASE " + " ".join(f"WHEN upper(x) = '{k}' THEN '{v}'" for k, v in passages.KINDS.items()) + " WHEN x LIKE '§%' THEN x[2:3] END"
    return f"""SELECT DISTINCT {key}, CASE WHEN a IN ('20', '40', '45') AND ({kind}) IS NOT NULL THEN a || ({kind}) WHEN x LIKE '§%' OR x LIKE '¤%' THEN x[2:3] WHEN x IN ('OT', 'FR') THEN x END AS code
      FROM (SELECT {key}, unnest(ws) AS x, unnest(list_concat([''], ws[1:len(ws) - 1])) AS a FROM (SELECT {key}, list_filter(regexp_extract_all({_marked(clause)}, '[0-9]+|[A-Za-z][A-Za-z0-9]*|[§¤][A-Z][A-Z]|[^\\sA-Za-z0-9-]'), lambda x: lower(x) NOT IN ({listed(("ft", "foot", "feet", "'", "’"))})) AS ws FROM {table}))"""


FIGURE_WORDS = "[0-9]+(?:[.,][0-9]+| [0-9][0-9][0-9])*|[A-Za-z]+|公斤|千克|吨|[^\\sA-Za-z0-9.]"


def masses(table: str, key: str, clause: str) -> str:
    """(key, n, kg): how many masses each clause that has any states, and their sum."""
    return f"SELECT {key}, count(*) AS n, sum(kg) AS kg FROM ({figures(table, key, clause)}) GROUP BY 1"


def figures(table: str, key: str, clause: str) -> str:
    """(key, i, last, kg): the masses of each clause, by the words (from 1) that state them: a number, its unit in the next word or two, and whether the words since the figure before say that it is the same one."""
    metric = {f"metric {t}": 1000.0 for t in ("ton", "tons", "tonne", "tonnes")}
    scales = ", ".join(f"({quoted(u)}, {v}::DOUBLE)" for u, v in {**passages.KILOGRAMS, **metric}.items())
    openers = listed(f"{a}{' ' + r if r else ''}" for a in passages.AGAIN for r in ("", *passages.ROUGHLY))
    money, mass = "|".join(passages.MONEY), "|".join(passages.MASS)
    return f"""WITH u(unit, scale) AS (VALUES {scales}),
      k AS (SELECT {key}, regexp_extract_all({clause}, '{FIGURE_WORDS}') AS ts,
        regexp_matches(lower({clause}), '(^|[^a-z])({money}|compensat\\w*|insur\\w*|invoice\\w*|per\\s+(day|week|month))([^a-z]|$)|£') AS money, regexp_matches(lower({clause}), '(^|[^a-z])({mass})([^a-z]|$)|重') AS mass FROM {table}),
      i AS (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM k),
      f AS (SELECT {key}, ts, i, money, mass, ts[i + 1] AS one, lower(ts[i + 2]) AS next, TRY_CAST(regexp_replace(ts[i], '[, ]', '', 'g') AS DOUBLE) AS v, coalesce(b.unit, a.unit) AS unit, coalesce(b.scale, a.scale) AS scale, i + CASE WHEN b.unit IS NULL THEN 1 ELSE 2 END AS last
        FROM i LEFT JOIN u a ON a.unit = lower(ts[i + 1]) LEFT JOIN u b ON b.unit = lower(ts[i + 1] || ' ' || ts[i + 2]) WHERE regexp_matches(ts[i], '^([0-9][0-9]?[0-9]?([, ][0-9][0-9][0-9])+|[0-9]+)([.][0-9]+)?$')),
      g AS (SELECT *, CASE WHEN regexp_matches(unit, '^(lb|pound|short|long|us )') THEN round(v * scale, 1) ELSE v * scale END AS kg FROM f WHERE scale IS NOT NULL
        AND CASE WHEN unit LIKE 'pound%' THEN mass AND NOT money WHEN one = 'mt' THEN mass AND coalesce(next, '') NOT IN ({listed(passages.LENGTHS)}) WHEN lower(one) = 'mt' THEN one = 'MT' ELSE true END),
      p AS (SELECT *, lag(kg) OVER o AS before, lag(last) OVER o AS since FROM g WINDOW o AS (PARTITION BY {key} ORDER BY i))
      SELECT {key}, i, last, kg FROM p WHERE NOT coalesce(lower(array_to_string(ts[since + 1:i - 1], ' ')) IN ({openers}) AND abs(kg - before) <= 0.03 * greatest(kg, before), false)"""


def sentences(table: str, key: str, clause: str) -> str:
    marked = f"regexp_replace({clause}, '{clauses.ABBREVIATED}', '\\1' || chr(2), 'g')"
    marked = f"regexp_replace({marked}, '([;。；])\\s*', '\\1' || chr(1), 'g')"
    marked = f"regexp_replace({marked}, '([a-z0-9)%\\]])\\.\\s+([A-Z(])', '\\1.' || chr(1) || '\\2', 'g')"
    return f"""SELECT {key}, n AS sentence_no, trim(replace(x, chr(2), '.')) AS sentence FROM (SELECT {key}, unnest(xs) AS x, generate_subscripts(xs, 1) AS n FROM (SELECT {key}, string_split({marked}, chr(1)) AS xs FROM {table})) WHERE trim(x) <> ''"""


def _read(sentence: str) -> str:
    for pattern, word in clauses.PHRASES:
        sentence = f"regexp_replace({sentence}, {quoted(pattern)}, '{word}', 'g')"
    return sentence


def _letters(words: str) -> str:
    case = " ".join(f"WHEN lower(w) IN ({listed(ws.split())}) THEN '{c}'" for c, ws in clauses.WORDS.items())
    out = f"array_to_string(list_transform({words}, lambda w: CASE {case} WHEN regexp_matches(w, '^[0-9]') THEN '9' ELSE 'w' END), '')"
    for pattern, code in clauses.CODES:
        out = f"regexp_replace({out}, '{pattern}', '{code}', 'g')"
    return out


def _joined(before: str, pattern: str) -> str:
    for _ in range(2):
        before = f"regexp_replace({before}, '{pattern}', '\\1j\\2', 'g')"
    return f"regexp_replace({before}, '{clauses.MIXED}', 'Q', 'g')"


def _alone(kind: str, tail: str) -> str:
    return f"CASE WHEN {kind} <> 'Q' AND NOT ({kind} = 'C' AND regexp_matches(regexp_replace({tail}, 'i[^ksb]*', '', 'g'), '{clauses.OTHER}')) THEN {kind} END"


def mass_limits(table: str, key: str, clause: str) -> str:
    """(key, container_kg, basis, package_kg, vehicle_kg, unplaced): figures as lists, by the letters of each sentence."""
    k, has, first = clauses, "regexp_matches", "regexp_extract"
    rest = f"regexp_replace(letters, '{k.ASIDE}', '', 'g')"
    for pattern in k.UPPER:
        rest = f"regexp_replace({rest}, '{pattern}', 'w', 'g')"
    basis = "CASE " + " ".join(f"WHEN {has}(letters, '{p}') THEN '{b}'" for p, b in k.BASIS) + " ELSE 'unstated' END"
    about = f"{has}(lower(read), '(^|[^a-z])({'|'.join(k.TRANSPORT)})') OR {has}(letters, '[CM]') OR sid IN (SELECT sid FROM t WHERE code IS NOT NULL)"
    massy = f"{has}(lower(read), '(^|[^a-z])({'|'.join(passages.MASS)})([^a-z]|$)|重')"
    return f"""(WITH s AS (SELECT *, {key} * 100000 + sentence_no AS sid, {_read("sentence")} AS read FROM ({sentences(table, key, clause)})),
      l AS (SELECT *, {_letters(f"regexp_extract_all(read, '{FIGURE_WORDS}')")} AS letters FROM s), f AS ({figures("s", "sid", "read")}), t AS ({container_codes("s", "sid", "read")}),
      n AS (SELECT sid, count(*) AS n FROM f GROUP BY 1),
      a AS (SELECT l.*, coalesce(n, 0) AS n, {about} AS about, {has}(letters, '{k.LIMIT}') OR contains(lower(read), 'swl') AS own_limit, {massy} AS own_massy,
        NOT contains(letters, 'q') AND (NOT {has}({rest}, '{k.POSITIVE}') OR coalesce(n, 0) = 1 AND {has}(letters, '{k.REFUSED}')) AS own_upper FROM l LEFT JOIN n USING (sid)),
      b AS (SELECT *, own_limit OR own_massy AS speaks, coalesce({has}(lag(sentence) OVER w, '[;；]$'), false) AS after_semicolon, max(about) OVER (PARTITION BY {key}) AS transport FROM a WINDOW w AS (PARTITION BY {key} ORDER BY sentence_no)),
      c AS (SELECT *, max(CASE WHEN speaks OR NOT after_semicolon THEN sentence_no END) OVER (PARTITION BY {key} ORDER BY sentence_no) AS ruled FROM b),
      d AS (SELECT c.*, r.speaks AND r.own_limit AS limits, r.speaks AND r.own_massy AS weighs, NOT r.speaks OR r.own_upper AS upper, c.n > {k.DENSE_FIGURES} OR length(c.sentence) > {k.DENSE_CHARS} AS dense FROM c JOIN c r ON c.{key} = r.{key} AND c.ruled = r.sentence_no WHERE c.n > 0),
      e AS (SELECT *, CASE WHEN dense THEN limits AND (weighs OR transport) OR transport AND weighs ELSE limits AND transport AND NOT (upper AND own_upper) END AS whole FROM d),
      g AS (SELECT sid, kg, i - 1 AS here, last - 1 AS till, lag(last - 1) OVER (PARTITION BY sid ORDER BY i) AS since FROM f),
      h AS (SELECT e.*, kg, here, substr(letters, till + 2) AS after, substr(letters, since + 2, here - since - 1) AS inside, substr(letters, greatest(here - {k.LOOK_BACK}, 0) + 1, least(here, {k.LOOK_BACK})) AS back FROM e JOIN g USING (sid) WHERE whole OR NOT dense),
      i AS (SELECT *, CASE WHEN {has}(coalesce(inside, ''), '[CPKV]') THEN inside ELSE back END AS before FROM h),
      j AS (SELECT *, {_joined("before", k.LISTED)} AS held, {_joined("before", k.LISTED_LOOSELY)} AS loose FROM i),
      m AS (SELECT *, CASE WHEN {has}(regexp_replace(loose, '^.*[ksA]', ''), '{k.ANY}') THEN regexp_replace(loose, '^.*[ksA]', '') ELSE loose END AS part, {first}(held, '{k.NEAREST}', 1) AS near FROM j),
      o AS (SELECT *, CASE WHEN NOT (limits AND (weighs OR transport)) OR whole THEN NULL WHEN {has}(after, '{k.AFTER}') THEN {first}(after, '{k.AFTER}', 1)
        WHEN NOT {has}(before, '[CPKV]') THEN nullif({first}(after, '{k.NEXT}', 1), '')
        WHEN after LIKE 'E%' THEN {_alone(f"{first}(part, '{k.OWN_FIRST}', 1)", f"{first}(part, '{k.OWN_FIRST}', 2)")}
        WHEN {has}(held, '{k.CONTENTS}') AND ({_alone("'C'", f"{first}(held, '{k.CONTENTS}', 2)")}) IS NOT NULL THEN 'C'
        WHEN {has}(held, '{k.FRAME_MASS}') THEN nullif({first}(held, '{k.FRAME_MASS}', 1), 'Q')
        WHEN {has}(held, '{k.FRAME_EACH}') THEN {_alone(f"{first}(held, '{k.FRAME_EACH}', 1)", f"{first}(held, '{k.FRAME_EACH}', 2)")}
        WHEN {has}(held, '{k.FRAME_NOUN}') THEN nullif({first}(held, '{k.FRAME_NOUN}', 1), 'Q')
        WHEN near IN ('P', 'K') AND {has}(held, '[CQ]') OR near = 'C' AND {has}(letters, '[VK]') THEN NULL ELSE nullif(near, 'Q') END AS kind FROM m),
      p AS (SELECT *, CASE WHEN kind = 'C' THEN CASE WHEN kg BETWEEN {k.CONTAINER_KG[0]} AND {k.CONTAINER_KG[1]} THEN 'container' ELSE 'implausible' END WHEN kind IN ('P', 'K') THEN 'package' WHEN kind = 'V' THEN 'vehicle'
        WHEN whole OR transport AND (limits OR weighs) THEN 'unplaced' END AS place, {basis} AS basis FROM o),
      q AS (SELECT *, count(*) FILTER (place = 'container') OVER (PARTITION BY {key}) > 0 AS sure FROM p WHERE place IS NOT NULL),
      u AS (SELECT {key}, string_agg(sentence, ' ... ' ORDER BY sentence_no) AS unplaced FROM (SELECT DISTINCT {key}, sentence_no, sentence FROM q WHERE place = 'unplaced' OR place = 'implausible' AND NOT sure) GROUP BY 1)
      SELECT {key}, coalesce(list_sort(list(DISTINCT kg) FILTER (place = 'container' OR place = 'implausible' AND sure)), []) AS container_kg,
        CASE WHEN any_value(sure) THEN CASE WHEN count(DISTINCT basis) FILTER (place = 'container') = 1 THEN min(basis) FILTER (place = 'container') ELSE 'unstated' END END AS basis,
        coalesce(list_sort(list(DISTINCT kg) FILTER (place = 'package')), []) AS package_kg, coalesce(list_sort(list(DISTINCT kg) FILTER (place = 'vehicle')), []) AS vehicle_kg, coalesce(any_value(unplaced), '') AS unplaced
      FROM q LEFT JOIN u USING ({key}) GROUP BY 1)"""
