"""Queries over whole tables that have no SQL, against scans by hand."""

import json
from collections import defaultdict

from marginalia.operators import tokens
from marginalia.plans import registry, text_queries

SF = "/root/testdata/sf0.001"


def matches(spark):
    out = defaultdict(set)
    for m in text_queries.mentions(spark, SF).collect():
        out[m.doc_id].add((m.start, m.stop, m.norm))
    return out


def texts(spark):
    return {r.doc_id: r.text for r in registry.table(spark, SF, "documents").collect()}


def test_context_negation_documents(spark):
    sentences = defaultdict(list)
    for t in tokens.sentence_numbers(tokens.tokenize(text_queries.documents(spark, SF))).collect():
        sentences[t.doc_id, t.sent_no].append((t.start, t.stop, t.string.upper()))
    found, want = matches(spark), defaultdict(lambda: [0, 0])
    for (doc, _), toks in sentences.items():
        lo, hi = min(t[0] for t in toks), max(t[1] for t in toks)
        ends = [a for a, _, w in toks if w in ("BUT", "HOWEVER")]
        scopes = [(a, min([e for e in ends if e > a], default=hi)) for a, _, w in toks if w in ("NO", "NOT", "WITHOUT", "NEVER")]
        for a, b, _ in found[doc]:
            if lo <= a and b <= hi:
                x = want[doc, "Negated" if any(s <= a and b <= e for s, e in scopes) else "Affirmed"]
                x[0] += 1
                x[1] += a
    got = {(r.doc_id, r.negation): [r.n, r.starts] for r in registry.QUERIES["context_negation_documents"](spark, SF).collect()}
    assert got == dict(want)


def test_export_inline_xml_documents(spark):
    found = matches(spark)
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")
    got = {r.doc_id: (r.xml, r.n_mentions) for r in registry.QUERIES["export_inline_xml_documents"](spark, SF).collect()}
    assert sum(n for _, n in got.values()) > 0
    plain = lambda s: s.replace("&quot;", '"').replace("&apos;", "'")  # noqa: E731  quotes may stand as they are
    for doc, text in texts(spark).items():
        xml, at, n = "", 0, 0
        for a, b, inst in sorted(found[doc], key=lambda m: (m[0], -m[1], m[2])):
            if a >= at:
                xml, at, n = xml + esc(text[at:a]) + f'<Mention inst="{esc(inst)}">' + esc(text[a:b]) + "</Mention>", b, n + 1
        assert (plain(got[doc][0]), got[doc][1]) == (plain(xml + esc(text[at:])), n)


def test_export_json_documents(spark):
    found = matches(spark)
    got = {r.doc_id: json.loads(r.json) for r in registry.QUERIES["export_json_documents"](spark, SF).collect()}
    for doc, text in texts(spark).items():
        want = defaultdict(list)
        for a, b, inst in sorted(found[doc]):
            want[inst[0]].append({"indices": [a, b]})
        assert got[doc] == {"text": text} | ({"entities": dict(want)} if want else {})
