"""Pages written by hand, (html, main text): layouts and class names of their own, none made by the generator."""

PAGES = [
    (
        """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Kiln notes</title></head><body>
<div class="css-19x0p"><a href="/">Potters Corner</a> <a href="/glaze">Glazes</a> <a href="/clay">Clays</a> <a href="/shop">Shop</a></div>
<div class="css-7tt2a"><div class="css-4kd1"><h1>Firing a small kiln in winter</h1>
<p>Cold air changes how a small kiln behaves, mostly during the first two hours. I fire in an unheated shed, and the elements work hard to bring the chamber up to two hundred degrees.</p>
<p>Open the lid by a finger's width until the steam has gone. After that, close it and leave the peephole plug out, so that the last moisture can escape without cracking the ware.</p>
<h2>What I changed this year</h2>
<p>I added a second layer of fibre under the floor. It took an afternoon, cost very little, and shortened the whole firing by about fifty minutes.</p>
<ul><li>Check the thermocouple before every firing.</li><li>Write down the time of each step, even the dull ones.</li><li>Never trust a cone that has been stored in a damp box.</li></ul>
</div></div>
<div class="css-0aa1"><p>Copyright Potters Corner. <a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a></p></div></body></html>""",
        "Firing a small kiln in winter\nCold air changes how a small kiln behaves, mostly during the first two hours. I fire in an unheated shed, and the elements work hard to bring the chamber up to two hundred degrees.\n"
        "Open the lid by a finger's width until the steam has gone. After that, close it and leave the peephole plug out, so that the last moisture can escape without cracking the ware.\nWhat I changed this year\n"
        "I added a second layer of fibre under the floor. It took an afternoon, cost very little, and shortened the whole firing by about fifty minutes.\nCheck the thermocouple before every firing.\n"
        "Write down the time of each step, even the dull ones.\nNever trust a cone that has been stored in a damp box.",
    ),
    (
        """<html><body bgcolor=white><table width=100%><tr><td colspan=2><center><a href=index.htm>Start</a> | <a href=trip.htm>Trips</a> | <a href=guest.htm>Guests</a></center></td></tr>
<tr><td width=120><a href=a.htm>Alps</a><br><a href=b.htm>Balkans</a><br><a href=c.htm>Corsica</a></td>
<td><h2>Three days around the lake</h2><p>We left the car at the mill and walked along the eastern shore, where the path is narrow but dry. The innkeeper told us, with some pride, that the bridge had been rebuilt by hand.
<p>On the second day it rained until noon. We read old newspapers in the kitchen, ate too much bread, and set out when the clouds had lifted from the ridge.
<p>The last stretch is steep; take it slowly, and take water. From the top one sees both valleys, and on a clear evening the sea.</td></tr>
<tr><td colspan=2><center><font size=1>Last change: May. <a href=mailto:x>Mail</a></font></center></td></tr></table></body></html>""",
        "Three days around the lake\nWe left the car at the mill and walked along the eastern shore, where the path is narrow but dry. The innkeeper told us, with some pride, that the bridge had been rebuilt by hand.\n"
        "On the second day it rained until noon. We read old newspapers in the kitchen, ate too much bread, and set out when the clouds had lifted from the ridge.\n"
        "The last stretch is steep; take it slowly, and take water. From the top one sees both valleys, and on a clear evening the sea.",
    ),
    (
        """<html><head><title>parse()</title><script>var a=1;</script></head><body><header><div><a href="/">libgrain</a></div><nav><a href="/install">Install</a><a href="/guide">Guide</a><a href="/api">API</a></nav></header>
<div class="grid-a"><div class="col-1"><ul><li><a href="#open">open</a></li><li><a href="#parse">parse</a></li><li><a href="#close">close</a></li><li><a href="#errors">errors</a></li></ul></div>
<main><h1>parse</h1><p>Reads one record from the stream and returns it as a value. The call blocks until a whole record has arrived, or until the stream ends.</p>
<pre>value = parse(stream, strict=True)</pre>
<p>With strict set, a record that breaks a rule raises an error; without it, the record is returned as text, and a warning is written to the log.</p>
<table><tr><td>stream</td><td>an open stream, in binary mode</td></tr><tr><td>strict</td><td>whether broken records are errors</td></tr></table></main></div>
<footer><p>Built from revision 12. <a href="/src">Source</a></p></footer></body></html>""",
        "parse\nReads one record from the stream and returns it as a value. The call blocks until a whole record has arrived, or until the stream ends.\nvalue = parse(stream, strict=True)\n"
        "With strict set, a record that breaks a rule raises an error; without it, the record is returned as text, and a warning is written to the log.\nstream\nan open stream, in binary mode\nstrict\nwhether broken records are errors",
    ),
    (
        """<html><body><div id="wrap9"><div id="hd9"><form action="/find"><input name=q><button>Go</button></form><ul><li><a href=/s>Soups</a><li><a href=/b>Bakes</a><li><a href=/d>Drinks</a></ul></div>
<div id="mid9"><article><h1>Rye bread without a tin</h1><p>This loaf needs a wet dough, a hot stone and a little patience. Mix the flour, the water and the starter in the evening, and leave the bowl covered until the morning.</p>
<aside>Try our weekly letter</aside><p>Fold the dough twice, with an hour between. Dust the board well, because the dough will stick to everything you own.</p>
<ol><li>Heat the stone for an hour.</li><li>Slide the loaf in, and throw a cup of water onto the oven floor.</li><li>Bake for fifty minutes, and let it cool before you cut it.</li></ol></article>
<div id="react9" class="comments"><h3>4 replies</h3><div><b>Ruth</b><p>Mine came out flat, but it tasted wonderful. Next time I will use less water.</p></div><div><b>Olaf</b><p>Thank you, this works with spelt too.</p></div></div></div>
<footer>All recipes may be copied freely. <a href=/i>Imprint</a></footer></div></body></html>""",
        "Rye bread without a tin\nThis loaf needs a wet dough, a hot stone and a little patience. Mix the flour, the water and the starter in the evening, and leave the bowl covered until the morning.\n"
        "Fold the dough twice, with an hour between. Dust the board well, because the dough will stick to everything you own.\nHeat the stone for an hour.\n"
        "Slide the loaf in, and throw a cup of water onto the oven floor.\nBake for fifty minutes, and let it cool before you cut it.",
    ),
    (
        """<html><body><section class="z1"><ul><li><a href=/1>Politics</a></li><li><a href=/2>Harbour</a></li><li><a href=/3>Sport</a></li><li><a href=/4>Weather</a></li></ul></section>
<section class="z2"><h1>Ferry line to reopen after nine years</h1><div>By Marta Lind, 4 May</div><p>The ferry between the old harbour and the islands will run again from the first of June, the council said on Tuesday.</p>
<p>Two boats have been bought second-hand; both are being painted in the yard at Norrvik. A third will follow "if the first summer goes well", said the mayor.</p>
<blockquote><p>We have waited for this for a long time, and now we will wait three more weeks, said a shopkeeper on the quay.</p></blockquote>
<p>Tickets will cost four crowns. Bicycles travel free, dogs pay half.</p></section>
<section class="z3"><h3>Read next</h3><ul><li><a href=/9>New pier delayed</a></li><li><a href=/8>Storm closes school</a></li></ul></section>
<section class="z4"><p>Evening Post, founded 1911. <a href=/t>Terms</a> <a href=/p>Privacy</a> <a href=/j>Jobs</a></p></section></body></html>""",
        "Ferry line to reopen after nine years\nBy Marta Lind, 4 May\nThe ferry between the old harbour and the islands will run again from the first of June, the council said on Tuesday.\n"
        "Two boats have been bought second-hand; both are being painted in the yard at Norrvik. A third will follow \"if the first summer goes well\", said the mayor.\n"
        "We have waited for this for a long time, and now we will wait three more weeks, said a shopkeeper on the quay.\nTickets will cost four crowns. Bicycles travel free, dogs pay half.",
    ),
]
