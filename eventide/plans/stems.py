"""Porter2 stems in SQL, so that the check can stem by itself: one CTE for each step of the published algorithm."""

from __future__ import annotations

# The 127 English stop words, the words with stems of their own and the endings of the published algorithm.
STOP = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the
and but if or because as until while of at by for with about against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very s t can will just don should now
""".split()
_WHOLE = "skis ski, skies sky, dying die, lying lie, tying tie, idly idl, gently gentl, ugly ugli, early earli, only onli, singly singl, sky sky, news news, howe howe, atlas atlas, cosmos cosmos, bias bias, andes andes"
_KEPT = "inning outing canning herring earring proceed exceed succeed"
_STEP2 = "tional tion, enci ence, anci ance, abli able, entli ent, izer ize, ization ize, ational ate, ation ate, ator ate, alism al, aliti al, alli al, fulness ful, ousli ous, ousness ous, iveness ive, iviti ive, biliti ble, bli ble, fulli ful, lessli less"
_STEP3 = "tional tion, ational ate, alize al, icate ic, iciti ic, ical ic, ful -, ness -"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize"


def _map(pairs: str) -> str:
    """A MAP literal of "from to" pairs; "-" is the empty string."""
    two = [p.split() for p in pairs.split(", ")]
    return "MAP {" + ", ".join(f"'{a}': '{b.strip('-')}'" for a, b in two) + "}"


def _ending(column: str, endings: list[str]) -> str:
    """The longest of the endings that the column has, else ''."""
    return f"regexp_extract({column}, '({'|'.join(sorted(endings, key=len, reverse=True))})$', 1)"


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _keys(pairs: str) -> list[str]:
    return [p.split()[0] for p in pairs.split(", ")]


_SHORT = "'^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$'"


def stems(words: str) -> str:
    """CTEs that end in ``stemmed(word, stem)``; ``words`` is a query of one column of words of [0-9a-z]."""
    return f"""st0 AS (SELECT DISTINCT word FROM ({words}) q(word)),
  st1 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM st0),
  st2 AS (SELECT *, CASE WHEN w ^@ 'gener' OR w ^@ 'arsen' THEN 5 WHEN w ^@ 'commun' THEN 6
      WHEN regexp_matches(w, '[aeiouy][^aeiouy]') THEN length(regexp_extract(w, '^.*?[aeiouy][^aeiouy]')) ELSE length(w) END AS r1 FROM st1),
  st3 AS (SELECT *, CASE WHEN regexp_matches(w[r1 + 1:], '[aeiouy][^aeiouy]') THEN r1 + length(regexp_extract(w[r1 + 1:], '^.*?[aeiouy][^aeiouy]')) ELSE length(w) END AS r2 FROM st2),
  st4 AS (SELECT * REPLACE (CASE WHEN w LIKE '%sses' THEN w[:-3] WHEN regexp_matches(w, 'ie[ds]$') THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END
      WHEN regexp_matches(w, '[aeiouy].*.s$') AND NOT regexp_matches(w, '[us]s$') THEN w[:-2] ELSE w END AS w) FROM st3),
  st5 AS (SELECT *, w IN ({_listed(_KEPT.split())}) AS kept, {_ending("w", ["eed", "eedly", "ed", "edly", "ing", "ingly"])} AS e FROM st4),
  st6 AS (SELECT *, left(w, length(w) - length(e)) AS b FROM st5),
  st7 AS (SELECT * REPLACE (CASE WHEN kept OR e = '' THEN w WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END
      WHEN NOT regexp_matches(b, '[aeiouy]') THEN w WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN b[:-2]
      WHEN r1 >= length(b) AND regexp_matches(b, {_SHORT}) THEN b || 'e' ELSE b END AS w) FROM st6),
  st8 AS (SELECT * REPLACE (CASE WHEN kept THEN w ELSE regexp_replace(w, '(.[^aeiouy])[yY]$|^([^aeiouy])[yY]$', '\\1\\2i') END AS w) FROM st7 WHERE length(w) > 2
      UNION ALL SELECT * FROM st7 WHERE length(w) <= 2),
  st9 AS (SELECT * REPLACE ({_ending("w", [*_keys(_STEP2), "ogi", "li"])} AS e) FROM st8),
  st10 AS (SELECT * REPLACE (CASE WHEN kept OR e = '' OR length(w) - length(e) < r1 THEN w WHEN e = 'ogi' THEN CASE WHEN w LIKE '%logi' THEN w[:-2] ELSE w END
      WHEN e = 'li' THEN CASE WHEN regexp_matches(w, '[cdeghkmnrt]li$') THEN w[:-3] ELSE w END ELSE left(w, length(w) - length(e)) || {_map(_STEP2)}[e] END AS w) FROM st9),
  st11 AS (SELECT * REPLACE ({_ending("w", [*_keys(_STEP3), "ative"])} AS e) FROM st10),
  st12 AS (SELECT * REPLACE (CASE WHEN kept OR e = '' OR length(w) - length(e) < r1 THEN w WHEN e = 'ative' THEN CASE WHEN length(w) - 5 >= r2 THEN left(w, length(w) - 5) ELSE w END
      ELSE left(w, length(w) - length(e)) || {_map(_STEP3)}[e] END AS w) FROM st11),
  st13 AS (SELECT * REPLACE ({_ending("w", [*_STEP4.split(), "ion"])} AS e) FROM st12),
  st14 AS (SELECT * REPLACE (CASE WHEN kept OR e = '' OR length(w) - length(e) < r2 OR (e = 'ion' AND NOT regexp_matches(w, '[st]ion$')) THEN w ELSE left(w, length(w) - length(e)) END AS w) FROM st13),
  st15 AS (SELECT * REPLACE (CASE WHEN kept THEN w WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(w[:-2], {_SHORT}))) THEN w[:-2]
      WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN w[:-2] ELSE w END AS w) FROM st14),
  stemmed AS (SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE coalesce({_map(_WHOLE)}[word], lower(w)) END AS stem FROM st15)"""


def english_terms(source: str, columns: str, text: str) -> str:
    """CTEs that end in ``et(columns, term)``: the stems of the words of ``text`` that aren't stop words, with repeats."""
    return f"""ew AS (SELECT {columns}, unnest(regexp_extract_all(lower({text}), '[0-9a-z]+')) AS word FROM {source}),
  ek AS (SELECT * FROM ew WHERE word NOT IN ({_listed(STOP)})),
  {stems("SELECT word FROM ek")},
  et AS (SELECT ek.* EXCLUDE (word), stem AS term FROM ek JOIN stemmed USING (word))"""
