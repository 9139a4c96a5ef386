"""Hand-labelled pages for the decision tree of ``html_text``: main text blocks start with MARK.

``PLAIN_PAGES`` have neither semantic tags nor telling names, so that only words and
links of a block and its neighbours can decide; ``stripped`` makes such a page of one
that has them.
"""

import re

MARK = "†"

PAGES = [
    # A news article with semantic tags, navigation, adverts, comments of readers.
    """<html><head><title>Bridge reopens</title><script>var x = 1;</script></head><body>
<header class="site-header"><a href="/">The Daily</a><p>Morning edition, updated at six</p></header>
<nav><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/weather">Weather today</a></li></ul></nav>
<div class="ad">Buy two lamps and get the third one for free this week only.</div>
<main><article><h1>†Bridge reopens after repairs</h1><p class="byline">†By Ann Miller</p>
<p>†The old bridge over the river was opened again on Monday, two months after the first cracks had been found in its northern arch.</p>
<p>†Drivers were glad.</p><p>†Yes.</p>
<p>†The town paid about half of the costs, and the rest came from the county, which owns <a href="/road">the road</a> on both sides.</p>
<h2>†What comes next</h2><ul><li>†New lamps in May</li><li>†A path for bicycles along the southern wall, once the ground is dry</li></ul>
<aside>Read more about old bridges in our weekend series on stone and steel.</aside>
<p>†Nobody was hurt.</p></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I have waited for this for so long and I think that the work was done very well indeed.</p></div><div class="comment"><p>Too late!</p></div></section></main>
<footer>Copyright The Daily. All rights reserved. <a href="/imprint">Imprint</a></footer></body></html>""",
    # A blog without semantic tags: a table of links, text in plain divs.
    """<html><body><div><a href="/">Home</a> <a href="/about">About me</a> <a href="/all">All posts</a></div>
<h1>†A week in the garden</h1>
<div>†On the first day it rained so hard that the young plants lay flat on the ground, and we carried the pots into the shed.</div>
<div>†Then the sun came back and stayed with us for the rest of the week, so everything that had been lost grew again.</div>
<div>†That was a surprise to all of us, and most of all to my uncle, who had told us to give up and to sow the seeds again.</div>
<div>†I will write more about it when the first beans can be picked and eaten.</div>
<div><a href="/a">Older post</a> <a href="/b">Newer post</a></div>
<div><a href="/t1">garden</a> <a href="/t2">weather</a> <a href="/t3">family</a></div><div>Contact us by mail</div></body></html>""",
    # A page of a shop: named containers only.
    """<body><div id="topbar"><span>Free delivery from fifty on</span></div><div class="main-menu"><ul><li><a href="1">Shoes</a></li><li><a href="2">Hats</a></li></ul></div>
<div class="breadcrumb"><a href="/">Start</a> / <a href="/hats">Hats</a></div>
<div class="post-content"><h1>†How to care for a felt hat</h1><p>†Brush it after every walk, always in the same direction, and let it dry far from the stove.</p><p>†Never wash it.</p>
<p>†If it has lost its shape, hold it over steam for a short while and form it with both hands until it looks like new.</p>
<form class="newsletter-form"><label>Your mail address</label><input name="m"><p>We send one letter a month and you can leave at any time.</p></form>
<p>†Moths do not like cedar wood.</p></div>
<div class="sidebar"><h3>Popular</h3><p>Our ten best hats of the year in one long list, with prices and pictures of each of them.</p></div>
<div class="cookie-notice"><p>We use cookies to make this shop work and to count our visitors. You can say no to the second kind.</p></div>
<div id="footer"><p>Hat shop, 12 Long Street, open every day but Sunday from nine to six.</p></div></body>""",
    # A manual page: long lists and short lines inside main text.
    """<body><nav class="toc"><a href="#a">Install</a><a href="#b">Use</a></nav><main><h1>†Manual of the small pump</h1><h2>†Install</h2><ol><li>†Close the tap.</li><li>†Fix the pump to the wall with the four screws that come with it.</li><li>†Open the tap.</li></ol>
<h2>†Use</h2><p>†Press the green button.</p><table><tr><th>†Speed</th><th>†Power</th></tr><tr><td>†1</td><td>†20</td></tr></table><p>†Done.</p></main>
<div role="complementary"><p>See also the manual of the large pump, which has two buttons and a lamp on top.</p></div>
<footer><ul><li><a href="/c">Contact</a></li><li>Version 3</li></ul></footer></body>""",
    # An article whose page furniture is long and whose text is short.
    """<body><div class="header"><p>Welcome to the page of the rowing club, which was founded more than a hundred years ago by seven friends.</p></div>
<div class="notice"><p>The boat house is closed on Friday because of the works on the roof; please use the side door.</p></div>
<article><h1>†Results</h1><p>†First: Mary.</p><p>†Second: Tom.</p><p>†See you.</p></article>
<div class="related"><h2>Related</h2><p>Last year the race was won by a crew from abroad after a close finish that nobody had expected.</p></div>
<section class="discussion"><p>Well done, all of you, and thanks to the people who made the cakes that we had after the race.</p><p>Nice</p></section>
<aside><a href="/join">Join the club</a></aside></body>""",
    # Plain old markup with tables for layout.
    """<body><table><tr><td><a href="a.html">Index</a></td><td><a href="b.html">Next chapter</a></td></tr></table><h2>†Chapter one</h2>
<p>†It was a cold night when the ship left the harbour, and only a few people stood on the pier to see it go.</p>
<p>†The captain said nothing for an hour, then he went below and wrote a long letter to his brother in the north.</p>
<p>†At dawn the wind turned, and with it the mood of the crew, who began to sing and to mend the sails.</p>
<p>†By noon they had forgotten the cold, the pier and the people who had come to see them leave the harbour.</p>
<p><a href="a.html">Index</a> | <a href="b.html">Next chapter</a> | <a href="c.html">Notes</a></p></body>""",
    # A page of links only.
    """<body><ul><li><a href="1">One page about boats</a></li><li><a href="2">Another page about trains and stations</a></li><li><a href="3">Planes</a></li></ul><p><a href="4">More of these</a></p><p>Last changed in June</p></body>""",
    # A log-in page: no main text.
    """<body><header><a href="/">Start</a></header><form><p>Enter your name and the word that we have sent you by mail, then press the button below.</p><label>Name</label><input></form><footer><p>Terms of use and rules of the house</p></footer></body>""",
    # Text outside any container, with furniture around.
    """<body><div class="navbar"><a href="1">Home</a><a href="2">Blog</a></div><p>†The museum shows forty pictures of the painter who lived in this street until he moved to the coast at the age of sixty.</p>
<p>†Most of them have never been shown before, as they belonged to his sister, who kept them in her attic for all her life.</p>
<p>†The show runs until the end of March.</p><div class="share-buttons"><a href="s">Share</a> this page with your friends and family</div>
<div class="comments-area"><p>I went there yesterday and can only say that you should go too, as long as it is open.</p></div></body>""",
    # Main text with many links, as in an encyclopedia.
    """<body><div role="navigation"><a href="1">Main page</a><a href="2">Random page</a></div><div id="content"><h1>†Willow</h1>
<p>†The <a href="w">willow</a> is a <a href="t">tree</a> that grows near <a href="r">rivers</a> and <a href="l">lakes</a> in the north.</p>
<ul><li>†<a href="a">White willow</a></li><li>†<a href="b">Bay willow</a></li></ul><blockquote>†A tree that bends does not break.</blockquote></div>
<div class="site-footer"><p>This text may be used freely if you name the place where you have found it.</p></div></body>""",
    # Furniture in plain containers around an article.
    """<body><div>You are reading the evening edition of our paper, printed in three towns along the coast.</div><div><a href="/">Home</a> and more</div>
<p>Our readers voted this page the clearest one of the year, for which we thank them very much, and we promise to keep it that way with short lines, large letters and no pictures that move.</p>
<article><h2>†Snow in April</h2><p>†It snowed again last night.</p><p>†The farmers had covered the young trees with straw, so most of the blossom will live.</p><p>†More is to come.</p></article>
<p>You can listen to this page while you are on the road; just press the button at the top, choose one of the four voices, and put the telephone back into your pocket before you drive on.</p><div>Weather by the coast guard, twice a day</div></body>""",
    # Short furniture without names or links around plain paragraphs.
    """<body><div>Evening edition</div><div>Number 48</div><div>Two coins</div><h1>†The well of the village</h1>
<p>†For three hundred years the people of the village have drawn their water from one well in the middle of the square.</p>
<p>†Now the pump has been taken away, and a stone with the names of the men who dug the well stands in its place.</p>
<p>†Some of the older people still come in the morning, sit on the bench and talk until the church bell rings.</p>
<div>Page 3</div><div>Printed here</div></body>""",
    # An article split by plain advert and share lines inside named boxes.
    """<body><div class="page"><div class="headline-ad">Lamps for every room, now at half the price until the end of the month.</div><div class="entry-content"><p>†Ships need pilots when they come close to the coast.</p>
<div class="ad-slot">Lamps for every room.</div><p>†A pilot knows every rock.</p><div class="social-links"><a href="1">Post</a> <a href="2">Mail</a></div><p>†That is why they are paid well.</p></div><div class="reply-list"><p>My father was a pilot and he would have liked this text a lot, as it says how it is.</p></div></div></body>""",
    # A short article under long furniture in plain containers.
    """<body><div>This paper is made by a small team in an old mill, and it is paid for by its readers alone, so if you like what you read here, please think about a gift of any size.</div>
<div>We also have a shop with books, maps and cups, open on every market day from nine in the morning until the church bell rings for noon, and by letter at all times.</div>
<main><p>†The ferry is back.</p><p>†It had been away for a month because its second engine had to be taken out and sent to the yard where it was built.</p></main>
<div>The crossword of last week was solved by forty readers, of whom three have won a basket of apples from the orchard behind the mill, and will hear from us by mail very soon.</div>
<div>Next week we write about roofs, about the best way to keep cats out of a kitchen, and about the long walk that our editor took along the old border in the hills.</div></body>""",
    """<html><body><main><h1>†On salt</h1><p>†Salt was carried over these hills on the backs of mules for more than six hundred years, and the path that they took can still be seen where it crosses the moor, worn so deep into the ground that a rider could pass along it without being seen from the farms on either side, which was of some use to those who did not want to pay the toll.</p><p>†The toll was high.</p><p>†It was paid at the bridge, in coin or in salt, and the keeper of the bridge had the right to keep one part in sixty for himself and to sell it in the market on the first day of each month, so that in the end he was richer than the merchants.</p><p>†One of them built the house with the two towers that you see on the left when you come from the north.</p></main><p>The society has printed this page with the help of its members, who pay a small sum every year and receive four letters and a map in return, and who are invited to walk the old path together on the last Sunday of August.</p></body></html>""",
    """<body><nav><a href="1">All lists</a><a href="2">Search</a></nav><article><h1>†Lakes of the region</h1><p>†These lakes can be reached on foot from one of the villages.</p><ul><li>†<a href="a">Black lake</a></li><li>†<a href="b">Lake of the monks</a></li><li>†<a href="c">Upper lake</a></li><li>†<a href="d">Lower lake</a></li></ul><p>†Sources:</p><p>†<a href="e">The water book of the county</a></p></article><footer><a href="3">Imprint</a></footer></body>""",
    """<body><nav><a href="1">News</a> <a href="2">Sport</a></nav><article><h1>†Late frost</h1><p>†The frost came in the second week of May and took most of the apples.</p><p>†Pears fared better.</p></article><nav><a href="3">Weather</a></nav></body>""",
    """<body><div class="menu"><a href="1">Shop</a></div><main><h2>†Salt and bread</h2><p>†Guests in this country are given salt and bread at the door.</p><p>†It is an old custom.</p></main><div class="footer"><a href="2">Imprint</a></div></body>""",
    """<body><ul class="nav-list"><li><a href="1">Home</a></li><li><a href="2">Work</a></li></ul><div class="content"><p>†By Tom Hill</p><p>†The bridge was drawn by a woman who never saw it, as she lived on the other side of the sea.</p><div class="related-links"><a href="3">Bridges</a> <a href="4">Towers</a></div><p>†She was paid twice.</p></div></body>""",
    """<body><header><a href="1">Club</a></header><article><h1>†Our spring walk</h1><p>†We meet at nine by the gate and walk to the chapel.</p><section class="related"><a href="2">Last walk</a></section><h2>†What to bring</h2><p>†Bring bread, water and a coat.</p></article></body>""",
]

# Tags and attributes that tell main text from page furniture.
SEMANTIC = re.compile(r"</?(?:main|article|section|nav|header|footer|aside)\\b[^>]*>|\\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\\s>]+)", re.I)


def stripped(page: str) -> str:
    """The page with its semantic tags made plain boxes and without its names."""
    return SEMANTIC.sub(lambda found: "" if not found[0].startswith("<") else "</div>" if found[0].startswith("</") else "<div>", page)


PLAIN_PAGES = [
    "<html><body><p>†This short page has one paragraph only, and there is nothing else to be read on it.</p></body></html>",
    "<body><p>†The shop is closed today.</p></body>",
    "<body><h1>†Notice of a meeting</h1><p>†The next meeting of the society takes place on the first Tuesday of May in the old school.</p><p>†Guests are welcome.</p></body>",
    """<body><div><a href="/">Home</a></div><div><a href="/n">News</a></div><div><a href="/c">Contact us</a></div><h1>†The mill by the lake</h1>
<p>†The mill was built before the road, and for a long time flour was carried away by boat.</p><p>†It stands still.</p><p>†In the last war the wheel was taken out and melted, and nobody has put in a new one since then.</p><p>†Come and see.</p><div><a href="/p">Print this page</a></div></body>""",
    """<body><ul><li><a href="1">Start</a></li><li><a href="2">Fish</a></li><li><a href="3">Birds of the coast</a></li></ul><h2>†Herring</h2><p>†The herring lives in large swarms and comes near the coast in spring.</p><p>†It is eaten fresh, salted or smoked.</p><h2>†Plaice</h2><p>†Plaice lie flat on the sand.</p>
<p>†They change their colour with that of the ground, which makes them hard to see for birds and for people.</p><p><a href="4">Next: birds</a> <a href="5">Back</a></p></body>""",
    """<body><p>†Dear reader,</p><p>†last month I promised to tell you how the story of the lost key ended, and here is what I know.</p><p>†It was found.</p><p>†A boy saw it in the grass behind the station when he looked for his ball, and he gave it to the man at the counter.</p><p>†Thank you, boy!</p></body>""",
    """<body><table><tr><td><a href="1">Top</a></td><td><a href="2">Up</a></td><td><a href="3">Next</a></td></tr></table><h3>†Step one</h3><p>†Take off the lid and let the water run out.</p><h3>†Step two</h3><p>†Clean the sieve with a brush.</p><p>†Do not use soap.</p><h3>†Step three</h3><p>†Put the lid back, turn it to the left until you hear a click, and fill in fresh water up to the red line.</p><p>†Done.</p></body>""",
    """<body><div><a href="1">Sign in</a> | <a href="2">Register</a> | <a href="3">Help</a></div><div>†Question: how do I keep bread fresh for more than two days?</div><div>†Answer: wrap it in a cloth and put it into a wooden box, never into the cold.</div><div>†It works.</div><div><a href="4">More questions</a></div><div><a href="5">Ask one</a></div></body>""",
    """<body><h1>†Timetable</h1><ul><li>†First boat at six</li><li>†Second boat at nine, not on Sundays</li><li>†Last boat at eight in the evening</li></ul><p>†Tickets are sold on board.</p><p><a href="1">Map</a></p><p><a href="2">Prices</a></p></body>""",
    """<body><p><a href="1">One</a></p><p><a href="2">Two and three</a></p><p><a href="3">All the other pages about the same thing</a></p><p><a href="4">Four</a></p></body>""",
    """<body><div><a href="1">Home</a></div><p>†The <a href="x">council</a> has agreed to plant forty trees along the southern road, as had been asked for by the people who live there.</p><p>†Work starts in <a href="y">autumn</a>.</p><p>†A list of the trees can be read in the town hall.</p><div><a href="2">Other news of the week</a></div><div><a href="3">Older news</a></div></body>""",
    """<body><div><a href="a">Blog</a></div><h1>†Soup</h1><p>†Cut the onions.</p><p>†Fry them in butter until they are brown, add water, salt and two spoons of flour, and let it all boil for half an hour.</p><p>†Stir now and then.</p><p>†Serve hot.</p><div><a href="b">Bread</a> <a href="c">Cake</a> <a href="d">Fish</a></div></body>""",
    """<body><p>†Rain fell all night.</p><p>†Rain fell all day too.</p><p>†The river rose by a metre, the bridge was closed for cars, and the school sent all the children home before noon.</p><p>†No one was hurt.</p></body>""",
    """<body><div><a href="1">English</a></div><div><a href="2">Deutsch</a></div><div><a href="3">Terms</a></div><div><p>†A lighthouse keeper writes down the weather every three hours.</p><p>†He also counts the ships.</p><blockquote>†Nothing is as long as a night without wind.</blockquote><p>†That is what the old keeper said to us when we went down the stairs.</p></div><div><a href="4">Top of page</a></div></body>""",
    """<body><div>†How long is the way to the top? Two hours, if you do not stop; three with children and a rest at the spring.</div><div>†Is there water? Yes.</div><div>†Where can I sleep? There is a hut with twenty beds, open from June until the first snow.</div></body>""",
    """<body><p><a href="1">Index</a> <a href="2">Search</a></p><pre>†The pump starts when the green lamp is on. It stops by itself after ten minutes.</pre><p>†See the label for the date.</p><p><a href="3">Next</a></p></body>""",
]

# Tags and attributes that tell main text from page furniture.
SEMANTIC = re.compile(r"</?(?:main|article|section|nav|header|footer|aside)\\b[^>]*>|\\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\\s>]+)", re.I)


def stripped(page: str) -> str:
    """The page with its semantic tags made plain boxes and without its names."""
    return SEMANTIC.sub(lambda found: "" if not found[0].startswith("<") else "</div>" if found[0].startswith("</") else "<div>", page)


PLAIN_PAGES = [
    "<html><body><p>†This short page has one paragraph only, and there is nothing else to be read on it.</p></body></html>",
    "<body><p>†The shop is closed today.</p></body>",
    "<body><h1>†Notice of a meeting</h1><p>†The next meeting of the society takes place on the first Tuesday of May in the old school.</p><p>†Guests are welcome.</p></body>",
    """<body><div><a href="/">Home</a></div><div><a href="/n">News</a></div><div><a href="/c">Contact us</a></div><h1>†The mill by the lake</h1>
<p>†The mill was built before the road, and for a long time flour was carried away by boat.</p><p>†It stands still.</p><p>†In the last war the wheel was taken out and melted, and nobody has put in a new one since then.</p><p>†Come and see.</p><div><a href="/p">Print this page</a></div></body>""",
    """<body><ul><li><a href="1">Start</a></li><li><a href="2">Fish</a></li><li><a href="3">Birds of the coast</a></li></ul><h2>†Herring</h2><p>†The herring lives in large swarms and comes near the coast in spring.</p><p>†It is eaten fresh, salted or smoked.</p><h2>†Plaice</h2><p>†Plaice lie flat on the sand.</p>
<p>†They change their colour with that of the ground, which makes them hard to see for birds and for people.</p><p><a href="4">Next: birds</a> <a href="5">Back</a></p></body>""",
    """<body><p>†Dear reader,</p><p>†last month I promised to tell you how the story of the lost key ended, and here is what I know.</p><p>†It was found.</p><p>†A boy saw it in the grass behind the station when he looked for his ball, and he gave it to the man at the counter.</p><p>†Thank you, boy!</p></body>""",
    """<body><table><tr><td><a href="1">Top</a></td><td><a href="2">Up</a></td><td><a href="3">Next</a></td></tr></table><h3>†Step one</h3><p>†Take off the lid and let the water run out.</p><h3>†Step two</h3><p>†Clean the sieve with a brush.</p><p>†Do not use soap.</p><h3>†Step three</h3><p>†Put the lid back, turn it to the left until you hear a click, and fill in fresh water up to the red line.</p><p>†Done.</p></body>""",
    """<body><div><a href="1">Sign in</a> | <a href="2">Register</a> | <a href="3">Help</a></div><div>†Question: how do I keep bread fresh for more than two days?</div><div>†Answer: wrap it in a cloth and put it into a wooden box, never into the cold.</div><div>†It works.</div><div><a href="4">More questions</a></div><div><a href="5">Ask one</a></div></body>""",
    """<body><h1>†Timetable</h1><ul><li>†First boat at six</li><li>†Second boat at nine, not on Sundays</li><li>†Last boat at eight in the evening</li></ul><p>†Tickets are sold on board.</p><p><a href="1">Map</a></p><p><a href="2">Prices</a></p></body>""",
    """<body><p><a href="1">One</a></p><p><a href="2">Two and three</a></p><p><a href="3">All the other pages about the same thing</a></p><p><a href="4">Four</a></p></body>""",
    """<body><div><a href="1">Home</a></div><p>†The <a href="x">council</a> has agreed to plant forty trees along the southern road, as had been asked for by the people who live there.</p><p>†Work starts in <a href="y">autumn</a>.</p><p>†A list of the trees can be read in the town hall.</p><div><a href="2">Other news of the week</a></div><div><a href="3">Older news</a></div></body>""",
    """<body><div><a href="a">Blog</a></div><h1>†Soup</h1><p>†Cut the onions.</p><p>†Fry them in butter until they are brown, add water, salt and two spoons of flour, and let it all boil for half an hour.</p><p>†Stir now and then.</p><p>†Serve hot.</p><div><a href="b">Bread</a> <a href="c">Cake</a> <a href="d">Fish</a></div></body>""",
    """<body><p>†Rain fell all night.</p><p>†Rain fell all day too.</p><p>†The river rose by a metre, the bridge was closed for cars, and the school sent all the children home before noon.</p><p>†No one was hurt.</p></body>""",
    """<body><div><a href="1">English</a></div><div><a href="2">Deutsch</a></div><div><a href="3">Terms</a></div><div><p>†A lighthouse keeper writes down the weather every three hours.</p><p>†He also counts the ships.</p><blockquote>†Nothing is as long as a night without wind.</blockquote><p>†That is what the old keeper said to us when we went down the stairs.</p></div><div><a href="4">Top of page</a></div></body>""",
    """<body><div>†How long is the way to the top? Two hours, if you do not stop; three with children and a rest at the spring.</div><div>†Is there water? Yes.</div><div>†Where can I sleep? There is a hut with twenty beds, open from June until the first snow.</div></body>""",
    """<body><p><a href="1">Index</a> <a href="2">Search</a></p><pre>†The pump starts when the green lamp is on. It stops by itself after ten minutes.</pre><p>†See the label for the date.</p><p><a href="3">Next</a></p></body>""",
    """<body><div><a href="1">Home</a> <a href="2">All letters</a></div><h1>†A letter from the island</h1><p>†When we came ashore there was nobody to be seen, so we left the boat at the stones and walked along the path between the walls until we reached the first house, where an old woman sat in front of the door and cleaned fish, and she told us without looking up that the others had gone to the far side of the island to cut peat and would not be back before dark.</p>
<p>†We stayed.</p><p>†In the evening they came down the hill with two carts, wet to the knees, and one of them, who turned out to be the teacher, asked us in and gave us bread and tea, and then told us how the school had been moved three times in his life, each time further from the sea, and how each time the children had carried the books on their backs in the rain.</p><p>†He laughed when he said it, but you could see that it had not been a small thing to any of them, and that they would do it again if they had to.</p><p>†I will write again in June.</p><div><a href="3">Next letter</a></div></body>""",
    """<body><ul><li><a href="1">Home</a></li><li><a href="2">Garden</a></li><li><a href="3">Tools and seeds</a></li></ul><div>†A hedge of beech keeps its leaves through the winter, brown and dry as they are, and so it gives shelter from the wind in the months in which you need it most, while a hedge of hawthorn is bare from November on but feeds the birds with its red berries and keeps out the goats of your neighbour with its thorns.</div>
<div>†Plant either of them in autumn, two to the metre, cut them back by a third in the first spring even if it hurts, and keep the ground free of grass for two years, as the roots of grass drink first and leave nothing to the young trees.</div><div>†Water them in dry weeks.</div><div>†After five years the hedge is as high as a man and can be cut once a year, in July, when the young birds have left their nests.</div><div><a href="4">Garden</a> <a href="5">Back to top</a></div></body>""",
    "<body>†The site of the old quarry is closed until the fence has been mended.</body>",
    "<body><div>†We have moved to the house across the street, and the bell is on the left.</div></body>",
    "<body><h2>†Answer</h2><p>†The word comes from the sea, like many words of our harbour, and it meant the rope that holds a net.</p></body>",
    "<body><p>†It was late.</p><p>†They walked home along the canal, and not one of them said a word until they reached the lock.</p></body>",
    "<body><p>†The judges read all the poems twice before they chose three.</p><p>†They agreed.</p><p>†The first prize goes to a girl of nine years from the village behind the dunes.</p></body>",
    "<body><div><a href='1'>Start</a></div><p>†Please ring twice if you come after dark, as the dog sleeps.</p></body>",
    "<body><div><a href='1'>Start</a></div><div><a href='2'>Maps</a></div><p>†The map of the northern valley is out of print, but you can see it in the library.</p></body>",
    "<body><p>†Fill the bowl with warm water, put in the wool, and wait for an hour.</p><p>†Rinse it.</p><p>†Then lay it flat on a cloth to dry.</p></body>",
]
