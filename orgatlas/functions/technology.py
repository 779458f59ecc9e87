"""Technologies seen in the headers and HTML of pages, one literal pattern per signature."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name, category and pattern (matched without regard to case) of each technology.
SIGNATURES = [
    ("WordPress", "CMS", r"/wp-content/|/wp-includes/|<meta name=\"generator\" content=\"WordPress"),
    ("Drupal", "CMS", r"Drupal\.settings|/sites/default/files/|x-drupal-cache|x-generator: drupal"),
    ("Joomla", "CMS", r"/media/jui/|<meta name=\"generator\" content=\"Joomla"),
    ("Webflow", "CMS", r"webflow\.com|data-wf-page|data-wf-site"),
    ("Wix", "CMS", r"static\.wixstatic\.com|x-wix-request-id"),
    ("Squarespace", "CMS", r"static1\.squarespace\.com|squarespace-cdn"),
    ("Ghost", "CMS", r"<meta name=\"generator\" content=\"Ghost"),
    ("HubSpot CMS", "CMS", r"x-hs-hub-id|hs-sites\.com|\.hubspotusercontent"),
    ("Contentful", "CMS", r"ctfassets\.net"),
    ("Sanity", "CMS", r"cdn\.sanity\.io"),
    ("Strapi", "CMS", r"x-powered-by: strapi"),
    ("Shopify", "E-commerce", r"cdn\.shopify\.com|x-shopify-stage|Shopify\.theme"),
    ("WooCommerce", "E-commerce", r"woocommerce"),
    ("Magento", "E-commerce", r"Mage\.Cookies|/static/version\d+/frontend/|x-magento"),
    ("BigCommerce", "E-commerce", r"cdn\d*\.bigcommerce\.com"),
    ("Stripe", "Payments", r"js\.stripe\.com"),
    ("PayPal", "Payments", r"paypal\.com/sdk/js|paypalobjects\.com"),
    ("Next.js", "JavaScript framework", r"/_next/static/|__NEXT_DATA__|x-powered-by: next\.js"),
    ("Nuxt", "JavaScript framework", r"/_nuxt/|__NUXT__"),
    ("React", "JavaScript framework", r"data-reactroot|react-dom(\.production)?(\.min)?\.js|__NEXT_DATA__|_reactListening"),
    ("Vue.js", "JavaScript framework", r"data-v-[0-9a-f]{8}|vue(\.runtime)?(\.global)?(\.prod)?(\.min)?\.js"),
    ("Angular", "JavaScript framework", r"ng-version=|ng-app="),
    ("Svelte", "JavaScript framework", r"class=\"[^\"]*svelte-[a-z0-9]+"),
    ("Gatsby", "JavaScript framework", r"___gatsby|/page-data/"),
    ("Astro", "JavaScript framework", r"astro-island|data-astro-cid"),
    ("jQuery", "JavaScript library", r"jquery(\.min)?(-\d[\d.]*)?\.js|jquery/\d"),
    ("Alpine.js", "JavaScript library", r"x-data=|alpinejs"),
    ("GSAP", "JavaScript library", r"gsap(\.min)?\.js|/gsap@"),
    ("Bootstrap", "UI framework", r"bootstrap(\.min)?\.(css|js)"),
    ("Tailwind CSS", "UI framework", r"tailwindcss|--tw-"),
    ("Cloudflare", "CDN", r"server: cloudflare|cf-ray:|/cdn-cgi/"),
    ("Akamai", "CDN", r"x-akamai|akamaihd\.net|akamaized\.net"),
    ("Fastly", "CDN", r"x-served-by: cache-|x-fastly|fastly-debug"),
    ("Amazon CloudFront", "CDN", r"x-amz-cf-id|cloudfront\.net"),
    ("Vercel", "Hosting", r"x-vercel-id|server: vercel"),
    ("Netlify", "Hosting", r"x-nf-request-id|server: netlify"),
    ("AWS", "Hosting", r"amazonaws\.com|x-amz-"),
    ("Google Cloud", "Hosting", r"server: gws|googleusercontent\.com|x-goog-"),
    ("WP Engine", "Hosting", r"x-powered-by: wp engine|wpengine"),
    ("Nginx", "Web server", r"server: nginx"),
    ("Apache", "Web server", r"server: apache"),
    ("Microsoft IIS", "Web server", r"server: microsoft-iis"),
    ("LiteSpeed", "Web server", r"server: litespeed"),
    ("PHP", "Language", r"x-powered-by: php|\.php[\"'?]"),
    ("ASP.NET", "Language", r"x-powered-by: asp\.net|__VIEWSTATE|x-aspnet-version"),
    ("Express", "Language", r"x-powered-by: express"),
    ("Google Analytics", "Analytics", r"google-analytics\.com|gtag\(|googletagmanager\.com/gtag/js"),
    ("Google Tag Manager", "Tag manager", r"googletagmanager\.com/gtm\.js|GTM-[A-Z0-9]{4,}"),
    ("Meta Pixel", "Advertising", r"connect\.facebook\.net/[^\"']*/fbevents\.js|fbq\("),
    ("LinkedIn Insight", "Advertising", r"snap\.licdn\.com|_linkedin_partner_id"),
    ("Google Ads", "Advertising", r"googleadservices\.com|AW-\d{6,}"),
    ("Hotjar", "Analytics", r"static\.hotjar\.com|hjSiteSettings"),
    ("Microsoft Clarity", "Analytics", r"clarity\.ms"),
    ("Mixpanel", "Analytics", r"cdn\.mxpnl\.com|mixpanel\.init"),
    ("Segment", "Analytics", r"cdn\.segment\.com"),
    ("Amplitude", "Analytics", r"cdn\.amplitude\.com"),
    ("HubSpot", "Marketing automation", r"js\.hs-scripts\.com|js\.hsforms\.net|_hsq"),
    ("Marketo", "Marketing automation", r"munchkin\.marketo\.net|mktoForms"),
    ("Pardot", "Marketing automation", r"pi\.pardot\.com"),
    ("Mailchimp", "Email marketing", r"chimpstatic\.com|list-manage\.com"),
    ("Salesforce", "CRM", r"\.force\.com|\.my\.salesforce\.com|salesforce\.com/embeddedservice"),
    ("Intercom", "Live chat", r"widget\.intercom\.io|intercomSettings"),
    ("Drift", "Live chat", r"js\.driftt\.com"),
    ("Zendesk", "Customer support", r"static\.zdassets\.com|\.zendesk\.com"),
    ("Tawk.to", "Live chat", r"embed\.tawk\.to"),
    ("Crisp", "Live chat", r"client\.crisp\.chat"),
    ("LiveChat", "Live chat", r"cdn\.livechatinc\.com"),
    ("Freshchat", "Live chat", r"wchat\.freshchat\.com"),
    ("Google reCAPTCHA", "Security", r"google\.com/recaptcha|recaptcha/api\.js"),
    ("hCaptcha", "Security", r"hcaptcha\.com/1/api\.js"),
    ("Cookiebot", "Cookie compliance", r"consent\.cookiebot\.com"),
    ("OneTrust", "Cookie compliance", r"cdn\.cookielaw\.org|optanon"),
    ("Google Fonts", "Font", r"fonts\.googleapis\.com"),
    ("Font Awesome", "Font", r"font-awesome|fontawesome"),
    ("Typekit", "Font", r"use\.typekit\.net"),
    ("YouTube embed", "Video", r"youtube\.com/embed/"),
    ("Vimeo", "Video", r"player\.vimeo\.com"),
    ("Calendly", "Scheduling", r"assets\.calendly\.com|calendly\.com/"),
    ("Greenhouse", "Recruiting", r"boards\.greenhouse\.io|greenhouse\.io/embed"),
    ("Lever", "Recruiting", r"jobs\.lever\.co"),
    ("Workable", "Recruiting", r"apply\.workable\.com"),
]
MOST_EVIDENCE = 80


def branches(pattern: str) -> list[str]:
    """The alternatives of a pattern, outside of its groups and classes."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 2 if c == "\\" else 1
    return [*out, pattern[start:]]


def required(branch: str) -> str:
    """The longest text that every match of an alternative has in it ('' if none is sure)."""
    runs, run, i = [], "", 0
    while i < len(branch):
        c, step = branch[i], 1
        if c == "\\" and not branch[i + 1].isalnum():
            run, step = run + branch[i + 1], 2
        elif c in "([":
            close, step = {"(": ")", "[": "]"}[c], 1
            while branch[i + step] != close:
                step += 2 if branch[i + step] == "\\" else 1
            step, run = step + 1, runs.append(run) or ""
        elif c in "?*{":  # what stands before may be missing
            step, run = (branch.index("}", i) - i + 1 if c == "{" else 1), runs.append(run[:-1]) or ""
        elif c in "+.^$\\":
            step, run = (2 if c == "\\" else 1), runs.append(run) or ""
        else:
            run += c
        i += step
    return max([*runs, run], key=len)


def detect_tech(pages: DataFrame, signatures: list[tuple[str, str, str]] = SIGNATURES, headers: str | None = None, most_chars: int | None = None) -> DataFrame:
    """(page_id, name, category, evidence): signatures that match the lower-cased headers and HTML of a page; with ``most_chars`` only so much of the HTML.

    A pattern runs only over pages that hold a text which one of its alternatives requires; those texts are looked for in the bytes of the page as they are.
    """
    hay = F.lower(F.concat(F.coalesce(headers, F.lit("")) if headers else F.lit(""), F.lit("\n"), F.left("html", F.lit(most_chars)) if most_chars else F.col("html")))
    rows = pages.where(F.length("html") > 0).select("page_id", hay.alias("hay"))

    def one(name: str, category: str, pattern: str):
        low = pattern.lower()
        texts = [required(b) for b in branches(low)]
        may = functools.reduce(operator.or_, [F.contains("hay", F.lit(t)) for t in texts]) if all(texts) else F.lit(True)
        found = F.when(may, F.regexp_substr("hay", F.lit(low)))
        return F.when(found.isNotNull(), F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), F.left(found, F.lit(MOST_EVIDENCE)).alias("evidence")))

    return rows.select("page_id", F.inline(F.array_compact(F.array(*[one(*s) for s in signatures]))))
