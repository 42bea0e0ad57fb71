"""Conversation repair, licence scans and the filter audit against plain versions, on odd rows too."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest

from ledgerline.llm import interactions, licences, turns
from ledgerline.llm.work import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, words string, part string, digest string, alone int, n_words bigint, spans int"


def frame(spark, rows):
    """Rows (doc_id, text, lang); more columns have names that operators use themselves."""
    return spark.createDataFrame([(*row, "w", "p", "d", 1, 2, 3) for row in rows], DOCS)


# --- conversations

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, at bigint, fault string, gone boolean, edits string"


def conversations(spark, rows):
    return spark.createDataFrame([(*row, -1, "x", True, "K") for row in rows], CONVERSATIONS)


def damaged(rows):
    for conv_id, turn, role, text in rows:
        spelled = ":".join(" " if v is None else str(v) for v in (conv_id, turn))
        role, text = (" " if v is None else v for v in (role, text))
        draw = zlib.crc32(spelled.encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        yield from [(conv_id, turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)


def repaired(rows):
    """Cost, edits and repaired turns by a walk over the grammar's states from the last row back."""
    follow = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    best = [(0, "", ()), (10, "II", ("user:", "assistant:")), (5, "I", ("assistant:",)), (0, "", ())]
    for (role, text), fault in reversed(rows):
        now = []
        for state in range(4):
            ways = [(best[state][0] + 2, "D" + best[state][1], best[state][2])]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] in follow[state]:
                    cost, edits, rest = best[follow[state][role[:1]]]
                    ways.append((cost + extra, "K" + edits, (f"{role}:{text}", *rest)))
                name = "assistant" if state == 2 else "user"
                cost, edits, rest = best[follow[state][name[0]]]
                ways.append((cost + extra + 1, "R" + edits, (f"{name}:{text}", *rest)))
            now.append(min(ways))
        for _ in range(3):
            for state in range(4):
                name = "assistant" if state == 2 else "user"
                cost, edits, rest = now[follow[state][name[0]]]
                now[state] = min(now[state], (cost + 5, "I" + edits, (f"{name}:", *rest)))
        best = now
    return best[0]


def plain_audit(rows):
    out, by_id = {}, {row[0]: [] for row in rows}
    for row in damaged(rows):
        by_id[row[0]].append(row[1:])
    for conv_id, own in by_id.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        known = [t for t, _, _ in own if t is not None]
        seen, faulty = set(), []
        for _, role, text in own:
            words = WORD.findall(text)
            fault = (
                "blank" if not words else "duplicate" if (role, text) in seen
                else "truncated" if words[-1][-1] not in ".!?" else ""
            )
            seen.add((role, text))
            faulty.append(((role, text), fault))
        initials = [role[:1] for _, role, _ in own]
        count = Counter(fault for _, fault in faulty)
        cost, edits, whole = repaired(faulty)
        out[conv_id] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0,
            *(count[f] for f in turns.FAULTS),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            edits,
            hashlib.sha256("\n".join(whole).encode()).hexdigest(),
        )
    return out


def audited(spark, rows):
    out = turns.conversation_audits(conversations(spark, rows), Scratch(spark, "t"))
    assert out.columns[:1] + out.columns[-2:] == ["conv_id", "audit", "repaired_sha256"]
    found = out.collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: tuple(r)[1:] for r in found}


def test_conversations_of_all_lengths(spark):
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", None, "Üser", "usher"]
    rows = []
    for conv_id in [None, *range(200)]:
        weights = [rng.random() ** 2 for _ in roles]
        for turn in range(rng.choice([1, 2, 5, 8, 20])):
            text = rng.choice(["", None, " \t\x0b", "Done. ", "é你?\n", "cut off", "no", f"{turn}!", f"x{turn}"])
            rows.append((conv_id, rng.choice([turn, turn, turn, None, -turn]), rng.choices(roles, weights)[0], text))
    rows += rows[:40]  # repeated rows
    rows += [(900, t, "user" if t % 2 else "assistant", f"{t} one." if t % 7 else "two") for t in range(1, 1500)]  # many blocks
    rows += [(901, 3, "user", "the same.")] * 700  # one row without end
    rows += [(902, 1, "user", "long " * 50_000 + "!"), (902, 2, "assistant", "so?")]
    assert audited(spark, rows) == plain_audit(rows)


def test_no_conversations(spark):
    assert audited(spark, []) == {}


def test_dropped_conversations_stay_with_nothing(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert audited(spark, [(gone, 0, "user", "x")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_blocks_change_nothing():
    rng = random.Random(2)
    for _ in range(1500):
        some = rng.choice([0, 1, 6])
        rows = [
            (rng.choices("suaz", [rng.random() for _ in range(4)])[0], rng.choices(["", *turns.FAULTS], [6, 1, 1, some])[0])
            for _ in range(rng.randint(0, 14))
        ]
        size = rng.choice([1, 2, 3, 5, 20])
        cut = [rows[i : i + size] for i in range(0, len(rows), size)] or [[]]
        cost, path = turns.walked([turns._block([f for _, f in b], [r for r, _ in b]) for b in cut])
        assert (cost, "".join(e for _, e in path)) == repaired([((r, "t"), f) for r, f in rows])[:2]


def test_repaired_turns_are_rows(spark):
    rows = conversations(spark, [(7, 1, "assistant", "Hi."), (7, 2, "assistant", "So."), (7, 4, "user", "Ok.")]).withColumn("gone", turns.F.lit(False))
    found, placed = turns.audits(rows, Scratch(spark, "t"))
    assert [(r.audit, r.cost, r.gaps) for r in found.collect()] == [("RKD", 3, 1)]
    out = sorted((r.place, r.edit, r.role, r.text) for r in turns.repaired(found, placed).collect())
    assert out == [(0, "R", "user", "Hi."), (1, "K", "assistant", "So.")]


# --- licences


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_matching_statistics_are_longest_runs():
    rng = random.Random(3)
    scanner = licences.Scanner(licences.PHRASES, licences.TEMPLATES)
    runs = {tuple(s[i:j]) for s in scanner.sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    pool = [t for _, t in licences.TEMPLATES] + list(licences.PHRASES.values())
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(pool).split()
            at = rng.randrange(len(words))
            parts += words[at : at + rng.randint(1, 15)] + ["foo"] * rng.randint(0, 1)
        ids = [scanner.vocabulary.get(w, -1) for piece in licences.words_of(" ".join(parts)) for w in piece]
        want = [max((n for n in range(i + 2) if tuple(ids[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(ids))]
        assert [run for _, run in scanner.automaton.statistics(iter(ids))] == want


def test_every_template_is_found_and_edited_ones_are():
    scanner = licences.Scanner(licences.PHRASES, licences.TEMPLATES)
    for label, text in licences.TEMPLATES:
        n = len(plain_words(text))
        _, _, spans, score = scanner.scan(f"Before. {text}\nafter")
        assert (label, 1, n, n, n) in spans and score == 1
        words = text.split()
        if len(words) > 60:  # two words changed, one left out, one put in
            words[12], words[25] = "other", "else"
            words = words[:18] + words[19:22] + ["more"] + words[22:]
            spans = scanner.scan("x " + " ".join(words))[2]
            assert any(s.label == label and s.length == n and s.covered >= 0.8 * n for s in spans)
    _, _, spans, score = scanner.scan("some words of a text that has no license of any kind and makes use of the software")
    assert not spans and score < licences.COVERED


def test_copies_of_a_licence_are_spans_each():
    scanner = licences.Scanner(licences.PHRASES, licences.TEMPLATES)
    n = 5
    _, found, spans, _ = scanner.scan("Released under the MIT License. " * 400 + "All rights reserved " * 3)
    assert [(s.label, s.first, s.last) for s in spans] == [("mit", i * n, i * n + n - 1) for i in range(400)]
    assert found == {2: [3, 2000, 2006]}


TEXTS = [
    None, "", " \n", "CC BY", "cc-by-nc 4.0 cc by\x00cc_by", "General  Public\tLicense, general public license",
    "all rights\nreserved. All Rights Reserved", "éall rights reserved", "all rights reservedé", "cc cc by by cc", "CC BY",
    "word " * 60_000 + "all rights reserved", "Licensed under CC BY-NC 4.0.", "ALL RIGHTS RESERVED" * 2,
]


def test_places_of_phrases(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "cc by", None), (3, "CC BY", "en")]
    out = licences.document_licences(frame(spark, rows))
    got = sorted(map(tuple, out.collect()), key=repr)
    want = []
    for i, text, _ in rows:
        words, starts, labels = plain_words(text), [], set()
        for label, phrase in licences.PHRASES.items():
            own = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(own)] == own]
            starts += at
            labels |= {label} if at else set()
        base = ",".join(sorted(labels))
        all_ = ",".join(sorted(labels | ({"cc-by-nc"} if text and "Licensed" in text else set())))
        ends = (min(starts), max(starts)) if starts else (None, None)
        want.append((i, len(words), len(starts), *ends, base, all_, bool(starts)))
    assert [(*r[:7], r[7] == 1) for r in got] == sorted(want, key=repr) and all(0 <= r[7] <= 1 for r in got)
    assert licences.document_licences(frame(spark, [])).collect() == []


# --- filter audit


def plain_interactions(docs, labels):
    def fails(i, text):
        words = WORD.findall(text)
        smaller = [j for j, t, _ in docs if (t or "") == text and j is not None and i is not None and j < i]
        tests = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": bool(smaller),
        }
        return {f for f, failed in tests.items() if failed}

    good, toxic = ({r[0] for r in labels if r[k] == 1} for k in (1, 2))
    rows, out = [(lang or "", fails(i, t or ""), i) for i, t, lang in docs], []
    for part in {p for p, _, _ in rows}:
        own, shapley, block = [r for r in rows if r[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                gone = sum(f in r[1] for r in own) - len(removed)
                lost = [sum(r[2] is not None and r[2] in s for r in removed) for s in (good, toxic)]
                block.append(
                    (part, "".join(order), step + 1, f, len(left), len(removed), gone, sum(r[1] == {f} for r in own), *lost)
                )
                shapley[f] += len(removed)
        out += [(*r, shapley[r[3]]) for r in block]
    return out


LABELS = "doc_id bigint, quality int, toxic int, part string"


def test_filter_audit(spark):
    rng = random.Random(9)
    texts = [
        None, "", "x", "same text", "many words here " * 120, " ".join(f"w{i}" for i in range(300)), "A" * 40 + " b" * 700,
        "a#b", "\x0b\x1c é你 " * 250, "long " * 50_000, " ".join(f"é{i}" for i in range(200)), "﻿X" * 33 + "y" * 1000,
    ]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(300)]
    docs += [(None, t, "en") for t in texts] + docs[:20]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "q") for i in range(0, 400, 2)]
    labels += [(4, 1, 1, "q"), (4, 0, 0, "q"), (None, 1, 1, "q")]
    out = interactions.document_filters(frame(spark, docs), spark.createDataFrame(labels, LABELS), Scratch(spark, "t"))
    assert out.columns[:4] == ["part", "filter_order", "step", "filter"]
    assert sorted(map(tuple, out.collect())) == sorted(plain_interactions(docs, labels))


@pytest.mark.parametrize("labelled", [True, False])
def test_filter_audit_of_little(spark, labelled):
    labels = spark.createDataFrame([(1, 1, 1, "q")] if labelled else [], LABELS)
    assert interactions.document_filters(frame(spark, []), labels, Scratch(spark, "t")).collect() == []
    out = interactions.document_filters(frame(spark, [(1, "x", None)]), labels, Scratch(spark, "t")).collect()
    assert len(out) == 600 and {r.good_lost for r in out} == ({0, 1} if labelled else {0})
