from lodeline.llm import pii, train_pii


def test_numbers_make_no_common_piece():
    """p4_found: a piece whose digits differ from message to message is not taken for common words if its number is long, together or apart, so what was found there is not taught as plain."""
    calls = [f"Write down {n}. Appelle le +33 6 39 {n} 63 51.\n0{n}{n}{n}" for n in range(10, 30)]
    common = train_pii.common_pieces([*calls, *[f"Count to {n}." for n in range(20)], *["7\n"] * 9])
    assert {train_pii.mask(x) for x in ("Write down 12.", "Count to 3.", "7")} == common
    text = calls[0]
    spans = [(text.index("+33"), text.index(".\n"), "phone"), (text.index("\n") + 1, len(text), "phone")]
    common.add("0")
    assert train_pii.kept("See 163424870.", [(4, 13, "phone")], {"See 0."}) == [(4, 13, "phone")]
    assert train_pii.kept(text, spans, common) == spans
    assert train_pii.kept("Count to 7. Ann", [(0, 5, "name")], common) == []


def test_errors_in_common_pieces_are_taught_again():
    common = {"session resumed", "0"}
    assert train_pii.wrongly(["session resumed", "163424870", "Ann Lee"], [[(0, 15, "name")], [(0, 9, "phone")], [(0, 7, "name")]], common) == [("session resumed", [])]
    assert train_pii.without("call 123456 now", [(5, 11, "phone")]) == "call ****** now"


def test_records_of_the_service_are_no_persons():
    """p4_found: lines that the service itself writes hold nothing personal; a bare number on a line of its own is one."""
    assert pii.find_spans(["session resumed", "[tool] search_knowledge: 3", "(no answer)"]) == [[], [], []]
    assert pii.find_spans(["Merci ! Appelle le +33 6 39 98 63 51."]) == [[(19, 36, "phone")]]
