from loomwork.operators import facts


def _units(spark, texts):
    return spark.createDataFrame([(i, 1, i * 10, t) for i, t in enumerate(texts)], "unit_id int, subject int, us long, text string")


def test_preferences(spark):
    u = _units(spark, ["I love tea.", "I like tea", "I don't like soup.", "I don't hate rice.", "My favourite fruit is plums!", "I can't eat nuts.", "Do I love cake?", None, "", "I hate noise."])
    got = {(r.object, r.strength, r.positive) for r in facts.strongest(facts.preferences(u)).collect()}
    assert got == {("tea", "love_hate", True), ("soup", "like_dislike", False), ("plums", "favorite", True), ("nuts", "constraint", False), ("noise", "love_hate", False)}


def test_states(spark):
    u = _units(spark, ["I live in York. I have a dog", "I adopted a cat.", "I moved to Bath.", "I am 40 years old", "I'm 41.", "I speak Welsh", None])
    got = {(r.family, r.value): r.status for r in facts.current(facts.states(u)).collect()}
    assert got == {
        ("home", "york"): "historical", ("home", "bath"): "current", ("pets", "dog"): "current", ("pets", "cat"): "current",
        ("age", "40"): "historical", ("age", "41"): "current", ("languages", "welsh"): "current",
    }


def test_rules_and_revocation(spark):
    u = _units(spark, ["Always post notes in the team channel. Never embed keys.", "Forget the rule about notes in the team channel", "please always sign mail", None])
    got = {r.body: (r.kind, r.revoked_us) for r in facts.standing_rules(u).collect()}
    assert got == {"post notes in the team channel": ("obligation", 10), "embed keys": ("prohibition", None), "sign mail": ("obligation", None)}
    assert facts.standing_rules(u.limit(0)).count() == 0


def test_preferences_and_states(spark):
    said = [("ann", "I like tea. I live in Old Town"), ("ann", "I really love tea!"), ("bob", "I hate tea, I have visited Rome"), ("ann", "Now I live in New York. I have visited Rome"), ("ann", "I have visited Oslo"), ("bob", None)]
    u = spark.createDataFrame([(i, s, i, t) for i, (s, t) in enumerate(said)], "unit_id long, subject string, us long, text string")
    got = {(r.subject, r.object, r.positive, r.strength) for r in facts.strongest(facts.preferences(u)).collect()}
    assert got == {("ann", "tea", True, "love_hate"), ("bob", "tea", False, "love_hate")}
    got = {(r.subject, r.family, r.value, r.status) for r in facts.current(facts.states(u)).collect()}
    assert got == {("ann", "home", "old town", "historical"), ("ann", "home", "new york", "current"), ("bob", "visited", "rome", "current"), ("ann", "visited", "rome", "current"), ("ann", "visited", "oslo", "current")}
