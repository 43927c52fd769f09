"""Short given names, shared by the operators on names.

Most short forms follow a rule: the beginning of a name, perhaps with its last consonant doubled and -y or -ie behind
it. The others are listed, for common English given names whether or not any table has them.
"""

from __future__ import annotations

#: Common English short forms of given names that the rule does not give.
SHORT = {
    "abigail": "abby abbie gail", "alexander": "alex sasha xander sandy lex alec", "anastasia": "stacy ana nastya stacey anya", "augustin": "gus austin",
    "barbara": "barb babs bobbie", "bartholomew": "bart tolly", "beatrice": "bea trixie bee", "benjamin": "ben benji", "catherine": "kate cat katie kathy kit",
    "christopher": "chris kit topher kris", "clement": "clem", "cordelia": "delia", "daniel": "dan", "deborah": "deb", "dominic": "dom nic nick",
    "dorothea": "dora thea dot dottie dorothy", "edward": "ed eddie ted ned teddy", "eleanor": "ellie nell nora ella lena", "elizabeth": "liz beth betsy lizzie eliza betty libby",
    "emmanuel": "manny manu manuel emma", "ferdinand": "ferd nando", "florentine": "flora flo florence", "francesca": "fran frankie chesca cesca", "frederick": "fred rick",
    "gabriel": "gabe gab", "geoffrey": "geoff jeff", "gregory": "greg gregor", "gwendolyn": "gwen wendy", "harold": "hal", "helena": "lena nell helen",
    "henrietta": "etta hetty hettie", "hubert": "hugh bert hub", "ingrid": "inga inge", "irina": "ira rina", "isabella": "bella izzy isa bel", "jennifer": "jen jenn",
    "jonathan": "jon nathan johnny", "joseph": "joe joey jo", "julius": "jules jule", "karolina": "karo lina carol caro", "kimberly": "kim", "konstantin": "kostya kon stan",
    "lawrence": "larry laurie", "leonard": "len leo lenny", "lucinda": "cindy lu", "magdalena": "magda lena", "margaret": "maggie meg peggy marge greta", "matthew": "matt",
    "nathaniel": "nate nat nathan", "nicolette": "nicky nico nic nikki colette", "norbert": "norb bert", "octavia": "tavi tavy", "olivia": "liv livvy ollie",
    "oswald": "oz ozzie ossie", "patrick": "pat paddy rick", "penelope": "pen nell", "philippa": "pippa phil pip", "rebecca": "becky becca bec", "richard": "rick dick rich",
    "robert": "rob bob bobby bert", "rosalind": "roz rosa linda ros", "samuel": "sam", "stephanie": "steph stevie steffi", "susannah": "sue susan sanna",
    "theodore": "ted theo teddy", "timothy": "tim", "tobias": "tobi", "valentina": "val tina", "veronica": "ronnie vera nica", "victoria": "vicky tori vic", "walter": "walt",
    "william": "bill will billy liam", "winifred": "fred freda win",
    "adelaide": "addie heidi", "agnes": "aggie nessie", "albert": "al bert bertie", "alfred": "al fred freddie alf", "alice": "allie ally", "amelia": "millie mel amy", "andrew": "drew andy",
    "angela": "angie", "ann": "annie nan nancy", "anthony": "tony", "archibald": "archie", "arthur": "art artie", "bernard": "bernie", "bridget": "biddy bridie", "caroline": "carrie lina caro",
    "cecilia": "celia cissy", "charles": "chuck charlie chas chip", "charlotte": "lottie charlie lotte", "clarence": "clare", "cornelius": "neil connie", "cynthia": "cindy", "david": "dave davy",
    "denise": "denny", "dennis": "denny", "dolores": "lola lolly", "donald": "don donnie", "douglas": "doug", "edmund": "ed ned ted", "edwin": "ed ned", "eugene": "gene", "evelyn": "eve evie",
    "florence": "flo flossie", "frances": "fran fanny frankie", "francis": "frank fran", "franklin": "frank", "george": "georgie", "gerald": "gerry jerry", "gertrude": "trudy gertie", "gilbert": "gil bert",
    "harriet": "hattie", "henry": "hank harry hal", "herbert": "herb bert", "howard": "howie", "isaac": "ike zac", "jacob": "jake", "jacqueline": "jackie", "james": "jim jimmy jamie", "jane": "janie jenny",
    "jeremy": "jerry", "jessica": "jess", "john": "jack johnny jock", "judith": "judy", "katherine": "kate kathy kit katie kat", "kathleen": "kate kathy", "kenneth": "ken", "leonora": "nora", "lillian": "lily",
    "louis": "lou louie", "louisa": "lou", "lucille": "lucy", "marcus": "marc", "margery": "marge", "martha": "marty patty", "martin": "marty", "mary": "molly polly may mae", "matilda": "tilda tilly mattie",
    "maximilian": "max", "melissa": "lissa missy mel", "michael": "mike mick mickey micky", "mildred": "millie", "mitchell": "mitch", "nancy": "nan", "natalie": "nat", "nicholas": "nick nicky nico klaus", "pamela": "pam",
    "patricia": "pat patsy patty trish tricia", "peter": "pete", "phillip": "phil pip", "prudence": "prue", "rachel": "rae", "raymond": "ray", "reginald": "reg reggie", "roderick": "rod rick", "roland": "rollie",
    "ronald": "ron ronnie", "rudolph": "rudy", "russell": "russ", "sarah": "sally sadie", "sebastian": "seb bastian", "silvester": "sly", "solomon": "sol", "stephen": "steve stevie", "steven": "steve stevie",
    "sylvia": "syl", "teresa": "tess terry tessa", "terence": "terry", "thomas": "tom tommy", "vincent": "vin vince vinny", "virginia": "ginny ginger", "vivian": "viv", "wallace": "wally", "wilhelmina": "mina minnie billie",
    "zachary": "zach zack zac",
}

#: Short form to the given names it may stand for.
LONG: dict[str, tuple[str, ...]] = {}
for _full, _shorts in SHORT.items():
    for _s in _shorts.split():
        LONG[_s] = (*LONG.get(_s, ()), _full)


def regular(full: str) -> set[str]:
    """Short forms of a (folded) given name by the rule."""
    out = set()
    for n in (3, 4, 5):
        b = full[:n]
        if n < len(full):
            out |= {b, f"{b}y", f"{b}ie"}
            if b[-1] not in "aeiouy":
                out |= {f"{b}{b[-1]}y", f"{b}{b[-1]}ie"}
    return out


def fulls(given: str) -> tuple[str, ...]:
    """A given name, and the listed names it is short for."""
    return (given, *(x for x in LONG.get(given, ()) if x != given))


def same_given(a: str, b: str) -> bool:
    """Whether two given names are one, or one is short for the other, or both for a third."""
    return a == b or bool(set(fulls(a)) & set(fulls(b))) or any(y in regular(x) for p in fulls(a) for q in fulls(b) for x, y in ((p, q), (q, p)))


def beginnings(form: str) -> list[str]:
    """The beginnings of the given names a form is short for by the rule: the other way of ``regular``."""
    out = [form]
    for end in ("y", "ie"):
        if form.endswith(end):
            b = form[: -len(end)]
            out.append(b)
            if b[-2:-1] == b[-1:] and b[-1:] not in "aeiouy":
                out.append(b[:-1])
    return [b for b in out if 3 <= len(b) <= 5]
