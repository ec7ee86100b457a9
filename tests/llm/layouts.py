"""Pages laid out by hand, in ways that the training grammar doesn't know; each gives the page and its article's blocks."""


def page(body: str) -> str:
    return f"<html><head><title>A title</title><style>p{{}}</style></head><body>{body}</body></html>"


def numbers_in_a_table(g, say):
    cells = [[str(g.randint(1990, 2024)), f"{g.randint(1, 99)}.{g.randint(0, 9)}", f"{g.randint(1, 99)} %"] for _ in range(4)]
    first, last = [say() for _ in range(3)], [say() for _ in range(2)]
    rows = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in cells)
    article = ["The figures", *first, "Year", "Total", "Share", *(c for r in cells for c in r), *last]
    body = f"<nav><a href='/'>Home</a> <a href='/x'>Sport</a></nav><article><h1>The figures</h1>{''.join(f'<p>{x}</p>' for x in first)}<table><thead><tr><th>Year</th><th>Total</th><th>Share</th></tr></thead><tbody>{rows}</tbody></table>{''.join(f'<p>{x}</p>' for x in last)}</article><footer><p>Imprint and contact</p></footer>"
    return page(body), article


def menu_behind_the_text(g, say):
    text = [say() for _ in range(4)]
    return page(f"<div id='content'>{''.join(f'<p>{x}</p>' for x in text)}</div><ul class='menu'><li><a>Start</a></li><li><a>Archive</a></li><li><a>Contact</a></li></ul>"), text


def menu_in_the_same_element(g, say):
    text = [say() for _ in range(5)]
    return page(f"<div class='inner'><ul class='tabs'><li>Overview</li><li>Details</li></ul><div class='copy'>{''.join(f'<p>{x}</p>' for x in text)}</div></div><div class='bottom-bar'>Legal notice</div>"), text


def thread_inside_main(g, say):
    text, said = [say() for _ in range(4)], [say() for _ in range(3)]
    return page(f"<header><a>The Daily</a></header><main><div class='story'><h1>What happened</h1>{''.join(f'<p>{x}</p>' for x in text)}</div><div id='disqus_thread'>{''.join(f'<div class=post-reply><p>{x}</p></div>' for x in said)}</div></main>"), ["What happened", *text]


def comments_inside_the_article(g, say):
    text, said = [say() for _ in range(4)], [say() for _ in range(3)]
    return page(f"<article><h2>Our trip</h2>{''.join(f'<p>{x}</p>' for x in text)}<section class='comments'><h3>3 comments</h3>{''.join(f'<div class=comment><b>Ann</b><p>{x}</p></div>' for x in said)}</section></article>"), ["Our trip", *text]


def answers_in_a_list(g, say):
    text, said = [say() for _ in range(5)], [say() for _ in range(4)]
    return page(f"<div class='page'><div class='entry-content'><h1>A question</h1>{''.join(f'<p>{x}</p>' for x in text)}</div><ol id='responses'>{''.join(f'<li class=response><cite>Bob</cite><div class=response-body><p>{x}</p></div></li>' for x in said)}</ol><div class='footer'>© 2020 Company</div></div>"), ["A question", *text]


def lists_and_captions(g, say):
    text, items = [say() for _ in range(3)], [" ".join(say().split()[: g.randint(1, 4)]) for _ in range(4)]
    body = f"<div class='side-column'><ul><li>Latest</li><li>Popular</li></ul></div><div class='entry'><h1>How to do it</h1><p>{text[0]}</p><figure><img src='a.png'><figcaption>{items[0]}</figcaption></figure><ul><li>{items[1]}</li><li>{items[2]}</li></ul><p>{text[1]}</p><ol><li>{text[2]}</li><li>{items[3]}</li></ol></div>"
    return page(body), ["How to do it", *text, *items]


def names_that_say_nothing(g, say):
    text = [say() for _ in range(6)]
    return page(f"<div class='jq-wrap'><div class='jq-head'><a>Log in</a></div><div class='jq-bx2'><h1>{text[0][:40]}</h1>{''.join(f'<p>{x}</p>' for x in text)}</div><div class='jq-ft'><p>All rights reserved</p></div></div>"), [text[0][:40].strip(), *text]


def code_and_definitions(g, say):
    text, code = [say() for _ in range(3)], [f"x{k} = load({g.randint(1, 99)})" for k in range(3)]
    terms = [" ".join(say().split()[:2]) for _ in range(2)]
    body = f"<article class='doc'><h1>Reference</h1><p>{text[0]}</p>{''.join(f'<pre>{c}</pre>' for c in code)}<dl><dt>{terms[0]}</dt><dd>{text[1]}</dd><dt>{terms[1]}</dt><dd>{text[2]}</dd></dl></article><aside><h3>Related</h3><ul><li>Install</li><li>Upgrade</li></ul></aside>"
    return page(body), ["Reference", *text, *code, *terms]


def sign_up_and_more_stories(g, say):
    text, more = [say() for _ in range(5)], [" ".join(say().split()[:6]) for _ in range(4)]
    body = f"<div class='cookie-bar'><p>We use cookies to improve this site.</p><button>Accept</button></div><main><section><h1>Big news</h1>{''.join(f'<p>{x}</p>' for x in text[:3])}<form class='newsletter'><label>Your mail</label><button>Subscribe</button></form>{''.join(f'<p>{x}</p>' for x in text[3:])}</section><div class='more-stories'><h3>More stories</h3><ul>{''.join(f'<li><a>{x}</a></li>' for x in more)}</ul></div></main><footer>About us</footer>"
    return page(body), ["Big news", *text]


LAYOUTS = {f.__name__: f for f in (numbers_in_a_table, menu_behind_the_text, menu_in_the_same_element, thread_inside_main, comments_inside_the_article, answers_in_a_list, lists_and_captions, names_that_say_nothing, code_and_definitions, sign_up_and_more_stories)}
