"""The injection detector on a labelled set of its own: attacks in the wild's usual forms, and texts that only look like some."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import injection

SQLI = """1' OR '1'='1
' or 1=1--
' or 'a'='a
" or "x"="x
admin'--
admin' #
1 OR 1=1
1) or (1=1
') or ('1'='1
1 UNION SELECT null, username, password FROM users
-1' union all select 1,2,3--
1'/**/union/**/select/**/1
1; DROP TABLE orders
x'; drop table members; --
1'; exec xp_cmdshell('dir')
1 and sleep(5)
1' and benchmark(1000000,md5(1))#
' and ascii(substring((select database()),1,1))>64--
1' waitfor delay '0:0:5'--
1%27%20or%201%3D1
1%2527%2520or%25201=1
' || '1'='1
1' order by 5--
' having 1=1--
1 or 2>1
' or 3 between 1 and 5 --
x' and 1=(select count(*) from tabname); --
' union select load_file('/etc/passwd')--
1' and extractvalue(1,concat(0x7e,version()))--
'; insert into users values(1,'h')--""".split("\n")
XSS = """<script>alert(1)</script>
<ScRiPt src=//evil.test/x.js>
"><script>alert(document.cookie)</script>
<img src=x onerror=alert(1)>
<svg onload=alert(1)>
<svg/onload=alert`1`>
" onmouseover="alert(1)
' onfocus='alert(1)' autofocus='
javascript:alert(1)
 JaVaScRiPt:alert(1)
java&#x09;script:alert(1)
javascript&#58;alert(1)
<a href="javascript:alert(1)">x</a>
<iframe src="data:text/html,x"></iframe>
<body onload=alert(1)>
%3Cscript%3Ealert(1)%3C/script%3E
%253Cscript%253Ealert(1)
<object data=evil.swf>
<base href=//evil.test/>
<meta http-equiv=refresh content=0;url=x>
<details open ontoggle=alert(1)>
" style="width:expression(alert(1))
<math><a xlink:href=javascript:alert(1)>x
<input autofocus onfocus=alert(1)>
vbscript:msgbox(1)""".split("\n")
FINE = """tea
O'Brien
rock and roll
black or white
it's 5 o'clock and all is well
select a colour from the list
union of concerned citizens
the union select committee
1 and 2
drop the table off at noon
1 + 1 = 2
price < 50 and price > 10
a=b&c=d
C# and F# tutorial
john -- the one from work
Tom & Jerry's "best" episodes
user@example.com
https://example.com/path?x=1&y=2
2024-01-05T10:00:00Z
I <3 scripts
what is javascript
javascript tutorial for beginners
on error resume next
onboarding = good
x < y > z
<b>bold</b>
'quoted' words
50% off; while stocks last
how to insert a picture; delete it later
d'Artagnan and the three musketeers
"to be or not to be"
sleep well
char (fish)
version 1.2.3-rc1
ORDER 66
null
(555) 123-4567
{"a": [1, 2]}
SGVsbG8gd29ybGQ=
l'eau et l'air
rock 'n' roll
the '90s and the '80s
5' 10" tall
tables; chairs; lamps
is 7 > 5 or 5 > 7?
%E2%9C%93 done
100%25 cotton
a/b/c
café and bar
the group by the lake""".split("\n")


def test_labelled_parameters(spark):
    rows = [(t, "sqli") for t in SQLI] + [(t, "xss") for t in XSS] + [(t, None) for t in FINE]
    df = spark.createDataFrame(rows, "t string, label string").withColumn("kind", injection.kind(F.col("t")))
    wrong = [(r["t"], r["label"], r["kind"]) for r in df.collect() if r["kind"] != r["label"]]
    print(wrong)
    assert sum(label is not None for _, label, _ in wrong) <= 3 and sum(label is None for _, label, _ in wrong) <= 1


def test_nothing_and_null(spark):
    df = spark.createDataFrame([("",), (None,), (" ",), ("%",), ("%zz' or 1=1--",)], "t string").withColumn("kind", injection.kind(F.col("t")))
    assert [r["kind"] for r in df.collect()] == [None, None, None, None, "sqli"]
