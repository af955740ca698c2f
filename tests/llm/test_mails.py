import pytest
from pyspark.sql import functions as F

from findling.llm import mails as M

CASES = {
    "plain": "Dear Ann,\n\nOn the phone Bob wrote: no, said: maybe.\nVon Montag an ist sie nicht da.\n\nKind regards\nBob".split("\n"),
}


def labels(body, sender=None):
    d = M.Decoder()
    return {no: M.LABELS[k] for no, k in d.labels(body, sender)}


def test_plain_mails_are_authored():
    body = "Dear Ann,\n\nOn the phone Bob wrote: no, said: maybe.\nVon Montag an ist sie nicht da. Das ist vertraulich, bitte nicht ausdrucken.\nIt still lay by registered post.\n- one\n- two\n\nKind regards\nBob\n\nPS: One more."
    assert set(labels(body).values()) == {"authored"}


def test_marked_quotation_with_wrapped_introduction():
    body = "Thanks.\r\n\r\nOn 2024-01-02 10:11, Ann Long\r\n<ann@x.test> wrote:\r\n\r\n> Hello\r\n>\r\n> > older\r\n\r\nMy answer in between.\r\n\r\n> more\r\n\r\nCheers\r\nBob"
    got = labels(body)
    assert [no for no, k in got.items() if k == "authored"] == [1, 10, 14, 15]
    assert got[3] == got[4] == "introduction" and got[6] == got[7] == "quoted"


@pytest.mark.parametrize("mark", ["> ", ">", "| ", "AL> ", ">> "])
def test_marks(mark):
    got = labels("Text.\n\nAm 01.02.24, 10:00 schrieb Ann:\n" + mark + "Hallo\n" + mark + "Gruß\n\nNeu.")
    assert [k for _, k in sorted(got.items())] == ["authored", "introduction", "quoted", "quoted", "authored"]


@pytest.mark.parametrize("head", [
    "-----Ursprüngliche Nachricht-----\nVon: A B <a@b.test>\nGesendet: 01.02.2024\nAn: C\nBetreff: X", "________________________________\nFrom: A B <a@b.test>\nSent: x\nTo: C",
    "Begin forwarded message:\n*De:* A <a@b.test>\n*Envoyé:* x\n*À:* B", "De: A <a@b.test>\nEnviado el: 1\nPara: B\nAsunto: C",
])
def test_open_quotations_reach_the_end(head):
    body = f"New text.\n\nCheers\nBob\n\n{head}\n\nOld text, longer than a line of a signature is.\n\nBest wishes\nAnn\n-- \nAnn\nTel. +00 1 555 0123"
    got = labels(body)
    assert [no for no, k in got.items() if k == "authored"] == [1, 3, 4] and got[max(got)] == "original"


def test_signatures_with_and_without_separator():
    sep = labels("Text one.\n\nCheers\nBob\n\n--\nBob Long\nCustomer Care\nGaku S.L.\nT +00 1 555 0123\nbob@x.test")
    assert [no for no, k in sep.items() if k == "authored"] == [1, 3, 4]
    bare = labels("Text one.\n\nCheers\nBob Long\n\nProperty Manager\nStoveth SARL", "Bob Long <b@x.test>")
    assert [no for no, k in bare.items() if k == "signature"] == [6, 7]
    under = labels("Text one.\n\nCheers\nBob Long\nCustomer Care\nGaku S.L.\nPhone +00 1 555 0123", "Bob Long <b@x.test>")
    assert [no for no, k in under.items() if k == "authored"] == [1, 3, 4]
    piped = labels("Text one.\n\nCheers\nBob\n\nHead of Archive | Binor eG | Tel. +00 1 555 0123")
    assert piped[6] == "signature"


def test_notes_notices_and_warnings():
    body = (
        "CAUTION: this email came from outside the organisation.\n\nText.\n\nCheers\nBob\nSent from my phone\n\n"
        "This message and any files sent with it are confidential and meant only\nfor the addressee. If you received it in error, please tell the sender\nand delete it.\n"
        "Binor eG, Sitz Berg, Registergericht Berg, HRB 12. Geschäftsführung: Ann Long.\nPlease think of the forest before you print this email."
    )
    got = labels(body)
    assert got[1] == "warning" and got[7] == "device" and {got[n] for n in range(9, 14)} == {"notice"}
    assert [no for no, k in got.items() if k == "authored"] == [3, 5, 6]


def test_wrongly_read_cues_still_count():
    assert labels("Txt.\n\nEl 2024-01-02 10:11, A B <a@b.test> escribiÃ³:\n> Hola")[3] == "introduction"
    assert labels("ATENCI├ôN: este correo procede del exterior.\n\nHola")[1] == "warning"


def test_operator(spark):
    long_ = "Some words of a very long mail. " * 20000
    rows = spark.createDataFrame(
        [(1, "Hi\n> old\n", "a", "z"), (1, "Hi\n> old\n", "a", "z"), (2, None, None, "z"), (3, "", "a", "z"), (4, " \r\n\t\n", None, "z"), (5, long_ + "\n>" * 3, "a", "z"), (None, "> x", "a", "z"), (6, "> only", "a", "z")],
        "mail_id long, body string, sender string, label string",
    )
    others = sorted((str(r.mail_id), r.line_no) for r in M.mail_lines(rows, others_only=True).collect())
    assert others == [("1", 2), ("1", 2), ("5", 2), ("5", 3), ("5", 4), ("6", 1), ("None", 1)]
    new = {r.mail_id: r.written for r in M.newly_written(rows).collect()}
    assert new[1] == "Hi" and new[2] is None and new[3] == "" and new[6] == "" and new[5] == long_
    assert M.newly_written(rows).count() == 8
    assert M.mail_lines(rows.where(F.lit(False))).count() == 0


def test_long_mails_take_time_in_proportion():
    import time

    from findling.llm.mails import Decoder

    def took(lines):
        began = time.perf_counter()
        got = Decoder().labels("\n".join(lines), "A. Writer")
        assert len(got) == len(lines)
        return time.perf_counter() - began

    for unit in (["--", "Tel. 0123 456789"], ["Please note that this message is confidential,"], ["On 1 May 2024 someone"], ["From: a@b.de", "To: c@d.de"], ["Anna Writer", "GmbH & Co"]):
        short, long = took(unit * (1000 // len(unit))), took(unit * (10_000 // len(unit)))
        assert long < 40 * short + 1, unit


def test_long_signatures_and_notices_lose_no_line():
    from findling.llm.mails import A, Decoder

    body = ["Hello,", "the papers are in the post.", "", "-- ", "Anna Writer"] + [f"Tel. 0123 45{k:04d}" for k in range(40)]
    assert [no for no, label in Decoder().labels("\n".join(body), "Anna Writer") if label == A] == [1, 2]
    notice = ["This message is confidential and meant for", "the recipient named in it only. If you are"] + ["not the one to whom this message was sent,"] * 12 + ["please delete it and tell the sender."]
    got = Decoder().labels("\n".join(["Hello,", "see below.", "", *notice]), None)
    assert [no for no, label in got if label == A] == [1, 2]
