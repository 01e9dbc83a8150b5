"""Labelled pages: layouts whose main text is marked by <!--keep--> and <!--skip--> comments.

They are the whole training set of ``main_text``: hand-made layouts of the kinds that news sites, blogs,
forums, shops, manuals and old table pages have, then one page for each usual name of a part, so that
every name is also seen by itself. The words do not matter, only elements and their names do.
"""

_WORDS = "The council met on Tuesday to talk about the new bridge and heard what people who live by the river had to say about it"

_LAYOUTS = [
    # An article element among navigation, an advert and a footer.
    f"""<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></nav>
    <div class="ad">Buy two and get one free this week only</div><article><!--keep--><h1>New bridge</h1><p>{_WORDS}.<p>Short.</p><p>{_WORDS}, <a href=/x>as reported</a>.</p><!--skip--></article>
    <footer>&copy; 2020 Town Press. All rights reserved.</footer></body></html>""",
    "<body><nav><a href=/>Home</a> <a href=/a>About us</a></nav><div class='ad'>Big sale now on in all our shops.</div><article><!--keep--><h1>Yes.</h1><p>Yes.</p><!--skip--></article><footer>Town Press, some street 5</footer></body>",
    "<body><nav><ul><li><a href=/>Home page</a></li></ul></nav><div class='ads banner'>An offer of the day.</div><article><!--keep--><h1>Two words</h1><p><b>Two words<br></p><!--skip--></article><footer>Contact and privacy</footer></body>",
    # main with a header of its own, a byline, share links, a figure, an aside and comments.
    f"""<body><header class="site-header"><div class="logo"><a href=/>The Paper</a></div><form class="search-form" action=/s><label>Search</label><input name=q><button>Go</button></form>
    <nav class="main-nav navigation menu"><a href=/1>World</a><a href=/2>Local</a></nav></header><div class="breadcrumbs breadcrumb"><a href=/>Home</a> &gt; <a href=/l>Local</a></div>
    <main id="main" role="main"><article class="post entry"><!--keep--><header class="entry-header"><h1 class="title headline">New bridge</h1></header><div class="entry-content"><p>{_WORDS}.</p>
    <h2>What was said</h2><blockquote>We want it.</blockquote><ul><li>It is wide.</li><li>It is long and made of stone.</li></ul><!--skip--><div class="share social sharing"><a href=#>Share</a> <a href=#>Tweet this</a></div>
    <aside class="related"><h3>Related stories</h3><ul><li><a href=/r>Old bridge closed</a></li></ul></aside><!--keep--><p>{_WORDS}.</p></div><!--skip--></article>
    <section id="comments" class="comments comment-list"><h3>2 comments</h3><div class="comment"><p class="comment-author">Ann says</p><p class="comment-body">I read it all and I think that the bridge is a very good thing for all of us</p></div>
    <div class="comment reply"><p>So do I but it costs too much money as I said before here</p></div><form class="comment-form respond"><label>Your name</label><textarea>Write here</textarea></form></section></main>
    <aside class="sidebar widget-area"><div class="widget popular"><h3>Most read</h3><ol><li><a href=/m>Cat saved from tree</a></li></ol></div><div class="newsletter subscribe signup"><p>Get our letter each week in your mail box</p></div></aside>
    <footer class="site-footer"><p>Printed in town. <a href=/p>Privacy</a> <a href=/t>Terms of use</a></p></footer><div class="cookie-notice cookie-banner consent">We use cookies to make this site better for you. <button>Accept</button></div></body>""",
    # No semantic elements: divs with names.
    f"""<body><div id="header"><h1 class="logo">Garden blog</h1><p class="tagline">All about plants</p></div><div id="nav" class="navbar menu"><ul><li><a href=/>Start</a></li><li><a href=/x>Archive</a></li></ul></div>
    <div id="wrapper" class="container"><div id="content" class="content"><div class="post"><!--keep--><h2 class="post-title">Roses</h2><div class="post-body text"><p>{_WORDS}.</p><p>{_WORDS}.</p><p>And that is all.</p></div><!--skip-->
    <div class="meta post-meta tags"><span>Posted in <a href=/c>plants</a></span> <span>Tags: <a href=/t>red</a></span></div><div class="advertisement sponsored promo">A word from our sponsor: get seeds at half the price today only</div></div>
    <div id="respond" class="comments-area discussion disqus"><h3>Leave a reply</h3><p>I love roses and have grown them for ten years now in my own garden</p></div></div>
    <div id="sidebar" class="sidebar column"><h3>About me</h3><p>I write about plants and live in the north with my cat.</p><ul><li><a href=/a>May</a></li><li><a href=/b>June</a></li></ul></div></div>
    <div id="footer" class="footer"><p>Made with care. All rights reserved by us.</p></div></body>""",
    # Table layout.
    f"""<body><table class="layout"><tr><td class="menu left"><a href=/>Home</a><br><a href=/l>Links</a><br><a href=/g>Guest book</a></td><td class="main body"><!--keep--><h1>My trip</h1><p>{_WORDS}.</p><p>{_WORDS}.</p>
    <table><tr><td>Day</td><td>Miles</td></tr><tr><td>One</td><td>12</td></tr></table><p>{_WORDS}.</p><!--skip--></td></tr><tr><td class="footer bottom">Best seen with any browser. Visitors: 120</td></tr></table></body>""",
    # A manual, with code, definition lists, a contents list and a pager.
    f"""<body><div class="skip-link skip"><a href=#c>Skip to content</a></div><div class="toolbar topbar"><a href=/>Docs</a></div><div class="toc contents"><ul><li><a href=#a>One</a></li><li><a href=#b>Two</a></li></ul></div>
    <div class="document" role="main"><section class="section"><!--keep--><h1>How to</h1><p>{_WORDS}.</p><pre><code>run it now</code></pre><dl><dt>name</dt><dd>what it is called</dd></dl><h3>More</h3><p>{_WORDS}.</p><figure><img><figcaption>What it looks like</figcaption></figure><!--skip--></section></div>
    <div class="pagination pager"><a href=/1>Back</a> <a href=/2>Next</a></div><footer role="contentinfo"><p>Built on Tuesday with a tool that makes pages out of plain files.</p></footer></body>""",
    # A page that is one form of the whole site, as some servers write them.
    f"""<body><form id="form1" action=/p><div class="header masthead"><a href=/>Ministry</a></div><div class="menu"><a href=/1>Law</a><a href=/2>Press</a></div><div class="main-content article-body story"><!--keep--><h1>Notice of works</h1><p>{_WORDS}.</p><p>{_WORDS}.</p><!--skip--></div>
    <div class="login account"><label>User</label><input><label>Key word</label><input><button>Log in</button></div><div class="footer copyright">Ministry of works, main street</div></form></body>""",
    # Notices before and within the text.
    f"""<body><div class="alert notice warning" role="alert">This site will be down for repairs on Sunday from two until four in the morning</div><div class="popup modal overlay dialog"><p>Please sign up to go on reading all of our stories for free</p><form><input><button>Sign up</button></form></div>
    <article><!--keep--><h1>Rain</h1><p>{_WORDS}.</p><!--skip--><div class="ad-slot ad advert">Advert: umbrellas for all at the best price in town</div><aside><p>Read more about rain and where it comes from in our long guide</p></aside>
    <div class="newsletter-signup"><p>Get the news by mail every day</p><form><input><button>Join</button></form></div><nav class="post-navigation"><a href=/p>Older</a> <a href=/n>Newer</a></nav><!--keep--><p>{_WORDS}.</p><p>{_WORDS}.</p><!--skip--><footer class="author-bio"><p>Ann writes about rain.</p></footer></article>
    <section class="recommended more-stories"><h2>You may also like</h2><div class="card teaser"><a href=/1>Snow</a><p>It fell on the hills and then on the town as well last night</p></div></section></body>""",
    # Nothing but text, or text in one element.
    f"<!--keep-->{_WORDS}. {_WORDS}.<!--skip-->",
    f"<html><head><title>T</title></head><body><!--keep--><p>{_WORDS}.</p><p>{_WORDS}.</p><!--skip--></body></html>",
    f"<body><div><!--keep-->{_WORDS}<br>{_WORDS}<!--skip--></div></body>",
    # A section with the text, links around it, no names at all.
    f"<body><div><a href=/>Home</a> | <a href=/f>Forum</a> | <a href=/h>Help</a></div><section><!--keep--><h1>Stones</h1><p>{_WORDS}.</p><p>{_WORDS}.</p><ol><li>First a stone.</li><li>Then a big stone.</li></ol><!--skip--></section><div><a href=/1>One</a> <a href=/2>Two</a></div></body>",
    # Pages without any main text.
    "<body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><div class='ad'>Only today: all hats for less.</div><article><h1></h1><p></p></article><footer>Hat shop, old street</footer></body>",
    "<body><header><a href=/>Shop</a></header><form><label>Name</label><input><label>Mail</label><input><button>Send</button><select><option>One</option><option>Two</option></select></form><footer><p>Hat shop, old street, open all days</p></footer></body>",
]

#: Usual names of parts that are no main text, in an article or beside it.
_ASIDE_NAMES = (
    "ad ads advert advertisement adsense adsbygoogle sponsor sponsored promo promotion banner teaser comment comments commentlist discussion respond replies reply disqus "
    "sidebar side secondary widget rail aside complementary related recommended popular trending more newsletter subscribe subscription signup login register "
    "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager toc share sharing social follow tags cookie cookies consent gdpr notice alert "
    "popup modal overlay dialog toolbar search form footer colophon copyright contentinfo header masthead topbar logo tagline skip"
).split()
_ASIDE_ELEMENTS = "nav aside footer form".split()
#: Usual names of parts that are main text.
_MAIN_NAMES = "content article post entry story body text main primary page document section".split()


def _pages_of_names() -> list[str]:
    p = f"<p>{_WORDS}.</p>"
    parts = [(f'<div class="{n}">', "</div>") for n in _ASIDE_NAMES] + [(f"<{n}>", f"</{n}>") for n in _ASIDE_ELEMENTS] * 4
    items = f"<ul><li>{_WORDS}</li><li>One more</li></ul>"
    out = []
    for start, end in parts:
        out.append(f"<body><article><!--keep--><h1>One</h1>{p}<!--skip-->{start}{p}{end}<!--keep-->{p}<!--skip--></article></body>")
        out.append(f"<body>{start}{_WORDS}{end}<div><!--keep--><h2>One</h2>{p}{p}<!--skip--></div>{start}<div>{_WORDS}</div>{end}</body>")
    for name in _MAIN_NAMES:
        out.append(f'<body><div>{_WORDS}</div><div class="{name}"><!--keep--><h1>One</h1>{p}<div>{_WORDS}</div><ul><li>One more</li></ul>{p}<!--skip--></div><div>{_WORDS}</div></body>')
    return out


PAGES = [*_LAYOUTS, *_pages_of_names()]
