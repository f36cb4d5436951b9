import collections
import re

from cohortlens.llm.quality_rules import RepetitionRules, keep_passing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, rules=RepetitionRules()):
    text = text or ""
    w = WORD.findall(text)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}

    def inside(n):
        grams = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
        c = collections.Counter(grams)
        return {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(n)}

    out["n_repeat_words"] = len(inside(3))
    seen, n, chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                n, chars = n + 1, chars + sum(map(len, WORD.findall(line)))
            seen.add(line)
    out["n_dup_lines"], out["dup_line_chars"] = n, chars
    for k in rules.max_ngram_share:
        out[f"cover_{k}"] = sum(len(w[i]) for i in inside(k))
    out["base_failed"] = len(w) < 50 or 100 * out["n_repeat_words"] > 50 * len(w)
    out["kept"] = not (out["base_failed"] or chars > rules.max_dup_line_share * out["word_chars"]
                       or out["n_symbols"] > rules.max_symbols_per_word * len(w)
                       or any(out[f"cover_{k}"] > s * out["word_chars"] for k, s in rules.max_ngram_share.items()))
    return out


def test_counts_match_brute_force(awkward, clashing):
    want = sorted((str(r.doc_id), sorted(brute(r.text).items())) for r in awkward.collect())
    for docs in (awkward, clashing):
        got = [r.asDict() for r in quality_rules(docs).collect()]
        got = sorted((str(r.pop("doc_id")), sorted(r.items())) for r in got)
        assert got == want


def test_filter_keeps_rows_and_columns(clashing, empty):
    kept = keep_passing(clashing)
    assert kept.columns == clashing.columns
    want = sorted(str(r.doc_id) for r in clashing.collect() if brute(r.text)["kept"])
    assert sorted(str(r.doc_id) for r in kept.collect()) == want and "1" in want and "56" not in want
    assert quality_rules(empty).count() == 0 and keep_passing(empty).count() == 0
