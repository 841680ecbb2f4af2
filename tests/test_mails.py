"""Messages read by column expressions, against the standard library's parser."""

import email
import email.policy
import hashlib
from email.message import EmailMessage

import pytest

from casefile.functions import mail
from casefile.sources import files


def message(subject, text, html=None, attachments=(), cte=None, charset="utf-8"):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"], m["Message-ID"] = "Änne <a@example.com>", "b@example.org, c@example.org", subject, "Mon, 6 May 2024 10:00:00 +0000", "<1@example.com>"
    m["Received"] = "from x by y; Mon, 6 May 2024 10:00:01 +0000"
    m["References"] = "<0@example.com> " * 12 + "<z@example.com>"
    m.set_content(text, cte=cte, charset=charset)
    if html:
        m.add_alternative(html, subtype="html", cte=cte)
    for name, data in attachments:
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return m.as_bytes()


MAILS = [
    message("plain", "hello\nworld\n"),
    message("Grüße aus Köln " * 8, "schöne Grüße = 100 %\n" + "lang " * 100 + "\n", cte="quoted-printable"),
    message("base64 é", "é" * 300 + "\n", "<p>é</p>\n", cte="base64"),
    message("attached", "see file\n", "<b>see</b>\n", [("a.bin", bytes(range(256)) * 20), ("b c.txt", b"x")]),
    message("latin", "caf\xe9\n", charset="iso-8859-1", cte="8bit"),
    message("=?x", "equals == =3D =\nnext\n", cte="quoted-printable"),
    message("boundaries", "--not a boundary\n-- \n", "<i>--</i>\n", [("r.eml", b"From: x\n\n--y--\n")]),
]


def stdlib(data):
    m = email.message_from_bytes(data, policy=email.policy.default)
    text = lambda kind: (lambda p: p.get_content() if p else "")(m.get_body((kind,)))
    found = [(p.get_filename(), p.get_content_type(), len(d := p.get_payload(decode=True)), hashlib.sha256(d).hexdigest()) for p in m.walk() if p.get_content_disposition() == "attachment"]
    return [str(m[h]) for h in ("From", "To", "Subject", "Date", "Message-ID", "References")], [str(r) for r in m.get_all("Received")], text("plain").rstrip("\n"), text("html").rstrip("\n"), found


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_equals_the_standard_library(spark, ends):
    rows = [(str(k), d if ends == "\n" else d.replace(b"\n", b"\r\n")) for k, d in enumerate(MAILS)]
    got = {int(r["path"]): r for r in mail.parsed(spark.createDataFrame(rows, "path string, content binary"), 1 << 20).collect()}
    for k, data in enumerate(MAILS):
        headers, received, text, html, found = stdlib(data)
        r = got[k]
        assert [r[c] for c in ("from", "to", "subject", "date_text", "message_id", "references")] == headers
        assert r["received_chain"] == received and r["body_text"].rstrip("\n") == text and r["body_html"].rstrip("\n") == html
        assert [tuple(a) for a in r["attachments"]] == found


def test_odd_messages(spark):
    odd = [("null", None), ("empty", b""), ("no head", b"just text without a head"), ("cut", MAILS[3][:900]), ("bytes", bytes(range(256))), ("bad base64", b"Content-Transfer-Encoding: base64\n\n@@@@"), ("long", b"Subject: s\n\n" + b"x" * 3_000_000)]
    got = {r["path"]: r for r in mail.parsed(spark.createDataFrame(odd, "path string, content binary"), 10).collect()}
    assert set(got) == {p for p, _ in odd} and got["null"]["body_text"] == "" and got["empty"]["subject"] is None
    assert got["bad base64"]["body_text"] == "@@@@" and len(got["long"]["body_text"]) == 3_000_000 and got["long"]["subject"] == "s"
    big = mail.parsed(spark.createDataFrame([("x", MAILS[3])], "path string, content binary"), 10).first()["attachments"]
    assert [a["sha256"] for a in big] == ["size_exceeded", hashlib.sha256(b"x").hexdigest()]


def test_a_folder_of_messages(spark, tmp_path):
    for k, data in enumerate(MAILS):
        (tmp_path / f"{k}.eml").write_bytes(data)
    assert files.read_messages(spark, str(tmp_path)).filter("subject = 'attached'").first()["attachments"][0]["size_bytes"] == 5_120
