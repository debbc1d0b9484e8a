"""Licence signatures: a hand-written pattern for the name of each licence and for the page it is published on, and the
sentence frames in which names stand. Patterns are Java regular expressions over text whose A-Z are lower-cased; a blank
stands for one to four characters that are neither letters nor digits."""

from __future__ import annotations

#: label ; keyword that must be in the text ; pattern of the name ; pattern of the page's address, or -
LICENCES = """
gpl-3.0 ; general ; (?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?,? (?:version |v)3(?:\\.0)? ; gnu\\.org/licenses/gpl-3
gpl-2.0 ; general ; (?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?,? (?:version |v)2(?:\\.0)? ; gnu\\.org/licenses/(?:old-licenses/)?gpl-2
gpl-1.0 ; general ; (?:gnu )?general public licen[sc]e,? (?:version |v)1(?:\\.0)? ; gnu\\.org/licenses/(?:old-licenses/)?gpl-1
gpl-any ; general ; gnu general public licen[sc]e ; gnu\\.org/licenses/gpl\\.html
lgpl-3.0 ; lesser ; (?:gnu )?lesser general public licen[sc]e,? (?:version |v)3(?:\\.0)? ; gnu\\.org/licenses/lgpl-3
lgpl-2.1 ; lesser ; (?:gnu )?lesser general public licen[sc]e,? (?:version |v)2\\.1 ; gnu\\.org/licenses/(?:old-licenses/)?lgpl-2\\.1
lgpl-2.0 ; library ; (?:gnu )?library general public licen[sc]e,? (?:version |v)2(?:\\.0)? ; gnu\\.org/licenses/old-licenses/lgpl-2\\.0
lgpl-any ; lesser ; gnu lesser general public licen[sc]e ; gnu\\.org/licenses/lgpl\\.html
agpl-3.0 ; affero ; (?:gnu )?affero general public licen[sc]e,? (?:version |v)3(?:\\.0)? ; gnu\\.org/licenses/agpl
agpl-1.0 ; affero ; affero general public licen[sc]e,? (?:version |v)1(?:\\.0)? ; affero\\.org/oagpl
agpl-any ; affero ; gnu affero general public licen[sc]e ; -
gfdl-1.3 ; documentation ; (?:gnu )?free documentation licen[sc]e,? (?:version |v)1\\.3 ; gnu\\.org/licenses/fdl-1\\.3
gfdl-1.2 ; documentation ; (?:gnu )?free documentation licen[sc]e,? (?:version |v)1\\.2 ; gnu\\.org/licenses/(?:old-licenses/)?fdl-1\\.2
gfdl-any ; documentation ; gnu free documentation licen[sc]e ; gnu\\.org/licenses/fdl
apache-2.0 ; apache ; apache(?: software)? licen[sc]e,? (?:version |v)?2(?:\\.0)? ; apache\\.org/licenses/license-2\\.0
apache-1.1 ; apache ; apache(?: software)? licen[sc]e,? (?:version |v)?1\\.1 ; apache\\.org/licenses/license-1\\.1
apache-1.0 ; apache ; apache(?: software)? licen[sc]e,? (?:version |v)?1\\.0 ; apache\\.org/licenses/license-1\\.0
apache-any ; apache ; apache software licen[sc]e ; apache\\.org/licenses
mit ; mit ; (?:the )?mit licen[sc]e ; opensource\\.org/licenses/mit
mit-x11 ; x11 ; (?:mit )?x11 licen[sc]e ; xfree86\\.org/3\\.3\\.6/copyright
mit-0 ; attribution ; mit no attribution(?: licen[sc]e)? ; opensource\\.org/licenses/mit-0
expat ; expat ; expat licen[sc]e ; jclark\\.com/xml/copying
bsd-4-clause ; bsd ; (?:original|old|4 clause|four clause) bsd licen[sc]e ; -
bsd-3-clause ; bsd ; (?:new|revised|modified|3 clause|three clause) bsd licen[sc]e ; opensource\\.org/licenses/bsd-3-clause
bsd-2-clause ; bsd ; (?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e ; opensource\\.org/licenses/bsd-2-clause
bsd-any ; bsd ; bsd licen[sc]e ; opensource\\.org/licenses/bsd-license
0bsd ; bsd ; (?:zero clause bsd|bsd zero clause|0bsd)(?: licen[sc]e)? ; opensource\\.org/licenses/0bsd
isc ; isc ; isc licen[sc]e ; opensource\\.org/licenses/isc
mpl-2.0 ; mozilla ; mozilla public licen[sc]e,? (?:version |v)?2\\.0 ; mozilla\\.org/(?:en-us/)?mpl/2\\.0
mpl-1.1 ; mozilla ; mozilla public licen[sc]e,? (?:version |v)?1\\.1 ; mozilla\\.org/mpl/(?:mpl-)?1\\.1
mpl-1.0 ; mozilla ; mozilla public licen[sc]e,? (?:version |v)?1\\.0 ; mozilla\\.org/mpl/(?:mpl-)?1\\.0
mpl-any ; mozilla ; mozilla public licen[sc]e ; mozilla\\.org/mpl
epl-2.0 ; eclipse ; eclipse public licen[sc]e(?: v| version)? ?2\\.0 ; eclipse\\.org/legal/epl-(?:v20|2\\.0)
epl-1.0 ; eclipse ; eclipse public licen[sc]e(?: v| version)? ?1\\.0 ; eclipse\\.org/legal/epl-v10
epl-any ; eclipse ; eclipse public licen[sc]e ; eclipse\\.org/legal/epl
edl-1.0 ; eclipse ; eclipse distribution licen[sc]e ; eclipse\\.org/org/documents/edl-v10
cpl-1.0 ; common ; common public licen[sc]e ; opensource\\.org/licenses/cpl1\\.0
ipl-1.0 ; ibm ; ibm public licen[sc]e ; opensource\\.org/licenses/ipl-1\\.0
cddl-1.1 ; common ; common development and distribution licen[sc]e,?(?: \\(cddl\\))?,? (?:version |v)?1\\.1 ; -
cddl-1.0 ; common ; common development and distribution licen[sc]e ; opensource\\.org/licenses/cddl
cc-by-4.0 ; attribution ; creative commons attribution 4\\.0(?: international)?(?: public)?(?: licen[sc]e)? ; creativecommons\\.org/licenses/by/4\\.0
cc-by-3.0 ; attribution ; creative commons attribution 3\\.0(?: unported)?(?: licen[sc]e)? ; creativecommons\\.org/licenses/by/3\\.0
cc-by-2.5 ; attribution ; creative commons attribution 2\\.5(?: generic)?(?: licen[sc]e)? ; creativecommons\\.org/licenses/by/2\\.5
cc-by-2.0 ; attribution ; creative commons attribution 2\\.0(?: generic)?(?: licen[sc]e)? ; creativecommons\\.org/licenses/by/2\\.0
cc-by-sa-4.0 ; alike ; creative commons attribution share ?alike 4\\.0(?: international)?(?: licen[sc]e)? ; creativecommons\\.org/licenses/by-sa/4\\.0
cc-by-sa-3.0 ; alike ; creative commons attribution share ?alike 3\\.0(?: unported)?(?: licen[sc]e)? ; creativecommons\\.org/licenses/by-sa/3\\.0
cc-by-nc-4.0 ; commercial ; creative commons attribution non ?commercial 4\\.0(?: international)?(?: licen[sc]e)? ; creativecommons\\.org/licenses/by-nc/4\\.0
cc-by-nc-3.0 ; commercial ; creative commons attribution non ?commercial 3\\.0(?: unported)?(?: licen[sc]e)? ; creativecommons\\.org/licenses/by-nc/3\\.0
cc-by-nd-4.0 ; derivatives ; creative commons attribution no ?derivatives 4\\.0(?: international)?(?: licen[sc]e)? ; creativecommons\\.org/licenses/by-nd/4\\.0
cc-by-nd-3.0 ; derivatives ; creative commons attribution no ?derivs? 3\\.0(?: unported)?(?: licen[sc]e)? ; creativecommons\\.org/licenses/by-nd/3\\.0
cc-by-nc-sa-4.0 ; commercial ; creative commons attribution non ?commercial share ?alike 4\\.0(?: international)?(?: licen[sc]e)? ; creativecommons\\.org/licenses/by-nc-sa/4\\.0
cc-by-nc-sa-3.0 ; commercial ; creative commons attribution non ?commercial share ?alike 3\\.0(?: unported)?(?: licen[sc]e)? ; creativecommons\\.org/licenses/by-nc-sa/3\\.0
cc-by-nc-nd-4.0 ; commercial ; creative commons attribution non ?commercial no ?derivatives 4\\.0(?: international)?(?: licen[sc]e)? ; creativecommons\\.org/licenses/by-nc-nd/4\\.0
cc-by-nc-nd-3.0 ; commercial ; creative commons attribution non ?commercial no ?derivs? 3\\.0(?: unported)?(?: licen[sc]e)? ; creativecommons\\.org/licenses/by-nc-nd/3\\.0
cc-by-any ; cc ; cc by(?: (?:sa|nc|nd)){0,2}(?: [1-4]\\.[05])? ; creativecommons\\.org/licenses/by
cc-any ; creative ; creative commons(?: [a-z]{2,14}){0,4} licen[sc]e ; creativecommons\\.org/licenses
cc0-1.0 ; cc0 ; cc0(?: 1\\.0)?(?: universal)? ; creativecommons\\.org/publicdomain/zero
cc-pdm ; domain ; public domain mark(?: 1\\.0)? ; creativecommons\\.org/publicdomain/mark
public-domain ; domain ; (?:in|into|to) the public domain ; -
unlicense ; unlicense ; the unlicense ; unlicense\\.org
wtfpl ; wtfpl ; wtfpl(?: version 2)? ; wtfpl\\.net
artistic-2.0 ; artistic ; artistic licen[sc]e,? (?:version |v)?2\\.0 ; opensource\\.org/licenses/artistic-2
artistic-1.0 ; artistic ; artistic licen[sc]e,? (?:version |v)?1\\.0 ; opensource\\.org/licenses/artistic-1
artistic-any ; artistic ; artistic licen[sc]e ; opensource\\.org/licenses/artistic-license
perl ; perl ; same terms as perl(?: \\d)?(?: itself)? ; dev\\.perl\\.org/licenses
zlib ; zlib ; zlib(?: libpng)? licen[sc]e ; zlib\\.net/zlib_license
libpng ; libpng ; libpng licen[sc]e(?: version 2)? ; libpng\\.org/pub/png/src/libpng-license
bsl-1.0 ; boost ; boost software licen[sc]e(?:,? version 1\\.0)? ; boost\\.org/license_1_0
busl-1.1 ; business ; business source licen[sc]e(?: 1\\.1)? ; mariadb\\.com/bsl11
elastic-2.0 ; elastic ; elastic licen[sc]e(?: 2\\.0)? ; elastic\\.co/licensing/elastic-license
sspl-1.0 ; side ; server side public licen[sc]e(?:,? (?:version |v)?1)? ; mongodb\\.com/licensing/server-side-public-license
python-2.0 ; python ; python(?: software foundation)? licen[sc]e(?:,? version 2)? ; python\\.org/psf/license
php-3.01 ; php ; php licen[sc]e(?:,? version 3\\.01?)? ; php\\.net/license
ruby ; ruby ; ruby licen[sc]e ; ruby-lang\\.org/en/about/license
openssl ; openssl ; openssl licen[sc]e ; openssl\\.org/source/license
ssleay ; ssleay ; ssleay licen[sc]e ; -
vim ; vim ; vim licen[sc]e ; vimdoc\\.sourceforge\\.net/htmldoc/uganda
w3c ; w3c ; w3c software(?: notice and)? licen[sc]e ; w3\\.org/consortium/legal
zpl-2.1 ; zope ; zope public licen[sc]e(?:,? version 2\\.1)? ; zope\\.org/resources/zpl
qpl-1.0 ; public ; q public licen[sc]e(?:,? version 1\\.0)? ; opensource\\.org/licenses/qtpl
afl-3.0 ; academic ; academic free licen[sc]e(?:,? version 3\\.0)? ; opensource\\.org/licenses/afl-3
osl-3.0 ; open ; open software licen[sc]e(?:,? version 3\\.0)? ; opensource\\.org/licenses/osl-3
ecl-2.0 ; educational ; educational community licen[sc]e(?:,? version 2\\.0)? ; opensource\\.org/licenses/ecl-2
eupl-1.2 ; european ; european union public licen[sc]e,? (?:version |v)?1\\.2 ; joinup\\.ec\\.europa\\.eu/page/eupl
eupl-1.1 ; european ; european union public licen[sc]e,? (?:version |v)?1\\.1 ; -
eupl-any ; european ; european union public licen[sc]e ; -
ncsa ; ncsa ; (?:university of illinois )?ncsa(?: open source)? licen[sc]e ; opensource\\.org/licenses/uoi-ncsa
ms-pl ; microsoft ; microsoft public licen[sc]e ; opensource\\.org/licenses/ms-pl
ms-rl ; microsoft ; microsoft reciprocal licen[sc]e ; opensource\\.org/licenses/ms-rl
apsl-2.0 ; apple ; apple public source licen[sc]e(?:,? version 2\\.0)? ; opensource\\.apple\\.com/(?:license/)?apsl
nasa-1.3 ; nasa ; nasa open source agreement(?: 1\\.3)? ; opensource\\.org/licenses/nasa1\\.3
postgresql ; postgresql ; postgresql licen[sc]e ; postgresql\\.org/about/licen[sc]e
ofl-1.1 ; font ; (?:sil )?open font licen[sc]e(?:,? version 1\\.1)? ; scripts\\.sil\\.org/ofl
lppl-1.3c ; latex ; latex project public licen[sc]e(?:,? version 1\\.3c?)? ; latex-project\\.org/lppl
cecill-2.1 ; cecill ; cecill(?: [bc])?(?: free software)? licen[sc]e(?:,? version 2\\.1)? ; cecill\\.info
mulan-2.0 ; mulan ; mulan (?:psl|permissive software licen[sc]e),? (?:version |v)?2 ; license\\.coscl\\.org\\.cn/mulanpsl2
upl-1.0 ; universal ; universal permissive licen[sc]e(?:,? (?:version |v)1\\.0)? ; opensource\\.org/licenses/upl
odbl-1.0 ; database ; open (?:data commons open )?database licen[sc]e(?: v?1\\.0)? ; opendatacommons\\.org/licenses/odbl
odc-by-1.0 ; commons ; open data commons attribution licen[sc]e ; opendatacommons\\.org/licenses/by
pddl-1.0 ; dedication ; public domain dedication and licen[sc]e ; opendatacommons\\.org/licenses/pddl
beerware ; beer ; beer ?ware licen[sc]e ; -
jsonorg ; json ; json licen[sc]e ; json\\.org/license
curl ; curl ; curl licen[sc]e ; curl\\.(?:se|haxx\\.se)/docs/copyright
hpnd ; historical ; historical permission notice and disclaimer ; opensource\\.org/licenses/hpnd
intel ; intel ; intel open source licen[sc]e ; opensource\\.org/licenses/intel
sleepycat ; sleepycat ; sleepycat(?: public)? licen[sc]e ; opensource\\.org/licenses/sleepycat
unicode ; unicode ; unicode licen[sc]e(?: v3)? ; unicode\\.org/license
proprietary ; reserved ; all rights reserved ; -
evaluation ; evaluation ; for evaluation (?:purposes )?only ; -
confidential ; confidential ; (?:strictly )?(?:company )?confidential and proprietary ; -
as-is ; warrant ; without warrant(?:y|ies) of any kind ; -
"""

#: Frame of a name: suffix of the rule's name, priority, text before and after the name.
FRAMES = [
    ("tag", 3, "spdx license identifier: ?", ""),
    ("grant", 2, "(?:licen[sc]ed|released|distributed|available|redistributed|provided)(?: [a-z]{1,12}){0,4} under(?: the)?(?: terms)?(?: of)?(?: the)? ", "(?: or (?:any )?later(?: version)?)?"),
    ("name", 1, "", ""),
]
EDGE_BEFORE, EDGE_AFTER, GAP = r"(?<![0-9a-z])", r"(?![0-9a-z])", "[^0-9a-z]{1,4}"


def _spaced(pattern: str) -> str:
    return pattern.replace(" ?", "\0").replace(" ", GAP).replace("\0", f"(?:{GAP})?")


def rules() -> list[dict]:
    """All rules in order: label, rule (its name), priority (3 first), keyword, pattern."""
    out = []
    for line in LICENCES.strip().splitlines():
        label, keyword, name, page = [x.strip() for x in line.split(" ; ")]
        tag = "[^0-9a-z]{1,2}".join(part.replace(".", r"\.") for part in label.removesuffix("-any").split("-"))
        for frame, priority, before, after in FRAMES:
            body = f"(?:{tag}|{_spaced(name)})" if frame == "tag" else f"{_spaced(name)}{_spaced(after)}"
            word = "spdx" if frame == "tag" else keyword
            out.append({"label": label, "rule": f"{label}/{frame}", "priority": priority, "keyword": word, "pattern": EDGE_BEFORE + _spaced(before) + body + EDGE_AFTER})
        if page != "-":
            out.append({"label": label, "rule": f"{label}/page", "priority": 3, "keyword": page.split("/")[0].replace("\\", "").split("(")[0].rstrip("."), "pattern": rf"(?:https?://)?(?:www\.)?{page}[-0-9a-z._/]*"})
    return out
