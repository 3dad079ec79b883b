"""The rows that the planted queries have to give: recorded from the library and reviewed, so they guard against change."""

from __future__ import annotations

ROWS: dict[str, tuple] = {
    "planted_routes": (
        ('blog', 'main/urls.py', 'django', 'mount', 'GET', '/blog', '^/blog/?$', 5),
        ('blog', 'main/urls.py', 'django', 'server', 'GET', '/', '^//?$', 4),
        ('blog', 'posts/urls.py', 'django', 'mount', 'GET', '/tags', '^/tags/?$', 6),
        ('blog', 'posts/urls.py', 'django', 'server', 'GET', '/archives', '^/archives/?$', 4),
        ('blog', 'posts/urls.py', 'django', 'server', 'GET', '/articles/<int:pk>', '^/articles/[^/]+/?$', 5),
        ('blog', 'tags/urls.py', 'django', 'server', 'GET', '/all', '^/all/?$', 2),
        ('mixed', 'app.py', 'flask', 'server', 'GET', '/search', '^/search/?$', 4),
        ('mixed', 'config/routes.rb', 'rails', 'server', 'GET', '/posts', '^/posts/?$', 2),
        ('mixed', 'main.go', 'go', 'server', 'ANY', '/health', '^/health/?$', 3),
        ('mixed', 'routes/web.php', 'laravel', 'server', 'GET', '/users/{id}', '^/users/[^/]+/?$', 3),
        ('mixed', 'src/main/java/org/acme/Api.java', 'spring', 'server', 'POST', '/api/util', '^/api/util/?$', 5),
        ('mono', 'apps/web/index.html', 'static', 'page', 'PAGE', '/apps/web', '^/apps/web/?$', 1),
        ('mono', 'apps/web/pages/blog/[slug].js', 'files', 'page', 'PAGE', '/blog/:slug', '^/blog/[^/]+/?$', 1),
        ('site', 'api/server.js', 'express', 'server', 'GET', '/api/users', '^/api/users/?$', 3),
        ('site', 'api/server.js', 'express', 'server', 'GET', '/api/users', '^/api/users/?$', 4),
        ('site', 'api/server.js', 'express', 'server', 'POST', '/api/users/:id', '^/api/users/[^/]+/?$', 5),
        ('site', 'index.html', 'static', 'page', 'PAGE', '/', '^//?$', 1),
        ('site', 'prices.html', 'static', 'page', 'PAGE', '/prices', '^/prices/?$', 1),
    ),
    "planted_mounted_routes": (
        ('blog', 'main/urls.py', '/'),
        ('blog', 'posts/urls.py', '/blog/archives'),
        ('blog', 'posts/urls.py', '/blog/articles/<int:pk>'),
        ('blog', 'tags/urls.py', '/blog/tags/all'),
        ('mixed', 'app.py', '/search'),
        ('mixed', 'config/routes.rb', '/posts'),
        ('mixed', 'main.go', '/health'),
        ('mixed', 'routes/web.php', '/users/{id}'),
        ('mixed', 'src/main/java/org/acme/Api.java', '/api/util'),
        ('mono', 'apps/web/index.html', '/apps/web'),
        ('mono', 'apps/web/pages/blog/[slug].js', '/blog/:slug'),
        ('site', 'api/server.js', '/api/users'),
        ('site', 'api/server.js', '/api/users/:id'),
        ('site', 'index.html', '/'),
        ('site', 'prices.html', '/prices'),
    ),
    "planted_links": (
        ('mono', 'apps/web/index.html', 1, 'asset', False, '/apps/web/src/main.tsx'),
        ('site', 'index.html', 6, 'href', False, '/nowhere'),
        ('site', 'index.html', 6, 'href', False, '/prices'),
        ('site', 'index.html', 7, 'asset', False, '/public/banner.png'),
        ('site', 'index.html', 8, 'asset', False, '/src/app.js'),
    ),
    "planted_imports": (
        ('blog', 'main/urls.py', 'from', 'blog', 'views', 'views', 2),
        ('blog', 'main/urls.py', 'from', 'django.urls', 'include', 'include', 1),
        ('blog', 'main/urls.py', 'from', 'django.urls', 'path', 'path', 1),
        ('blog', 'manage.py', 'import', 'os', '*', 'os', 1),
        ('blog', 'posts/urls.py', 'from', '.', 'views', 'views', 2),
        ('blog', 'posts/urls.py', 'from', 'django.urls', 'include', 'include', 1),
        ('blog', 'posts/urls.py', 'from', 'django.urls', 'path', 'path', 1),
        ('blog', 'posts/views.py', 'from', '.models', 'Post', 'Post', 1),
        ('blog', 'tags/urls.py', 'from', 'django.urls', 'path', 'path', 1),
        ('mixed', 'app.py', 'from', 'flask', 'Flask', 'Flask', 1),
        ('mixed', 'app.py', 'from', 'flask', 'request', 'request', 1),
        ('mixed', 'lib/main.dart', 'import', 'package:mixed/pages/home.dart', '*', '', 1),
        ('mixed', 'routes/web.php', 'use', 'App\\Models\\User', 'User', 'User', 2),
        ('mixed', 'src/main/java/org/acme/Api.java', 'import', 'org.acme.util.Tools', 'Tools', 'Tools', 2),
        ('mono', 'apps/web/src/main.tsx', 'esm', '#kit/colors', 'tone', 'tone', 3),
        ('mono', 'apps/web/src/main.tsx', 'esm', '@acme/kit', 'Button', 'Button', 2),
        ('mono', 'apps/web/src/main.tsx', 'esm', 'react', 'default', 'React', 1),
        ('mono', 'apps/web/src/main.tsx', 'side-effect', './app.css', '*', '', 4),
        ('mono', 'packages/kit/src/index.ts', 'reexport', './button', 'Button', 'Button', 1),
        ('mono', 'packages/kit/src/index.ts', 'reexport-all', './colors', '*', '*', 2),
        ('site', 'api/server.js', 'cjs', 'express', '*', 'express', 1),
        ('site', 'src/app.js', 'esm', './utils.js', 'default', 'lost', 2),
        ('site', 'src/app.js', 'esm', './utils.js', 'used', 'used', 1),
    ),
    "planted_import_edges": (
        ('blog', 'posts/urls.py', 'views', 'posts/views.py'),
        ('blog', 'posts/views.py', 'Post', 'posts/models.py'),
        ('mixed', 'lib/main.dart', '*', 'lib/pages/home.dart'),
        ('mixed', 'routes/web.php', 'User', 'lib/Models/User.php'),
        ('mixed', 'src/main/java/org/acme/Api.java', 'Tools', 'src/main/java/org/acme/util/Tools.java'),
        ('mono', 'apps/web/src/main.tsx', '*', 'apps/web/src/app.css'),
        ('mono', 'apps/web/src/main.tsx', 'Button', 'packages/kit/src/button.tsx'),
        ('mono', 'apps/web/src/main.tsx', 'Button', 'packages/kit/src/index.ts'),
        ('mono', 'apps/web/src/main.tsx', 'tone', 'packages/kit/src/colors.ts'),
        ('mono', 'packages/kit/src/index.ts', '*', 'packages/kit/src/colors.ts'),
        ('mono', 'packages/kit/src/index.ts', 'Button', 'packages/kit/src/button.tsx'),
        ('site', 'src/app.js', 'default', 'src/utils.js'),
        ('site', 'src/app.js', 'used', 'src/utils.js'),
    ),
    "planted_import_graph": (
        ('blog', 9, 2),
        ('mixed', 11, 3),
        ('mono', 14, 5),
        ('site', 13, 1),
    ),
    "planted_loaded_files": (
        ('mono', 'apps/web/src/main.tsx', 'script'),
        ('mono', 'apps/web/vendor-x.js', 'import map'),
        ('mono', 'apps/web/worker.js', 'worker'),
        ('mono', 'packages/kit/src/index.ts', 'manifest'),
        ('site', 'api/server.js', 'manifest'),
        ('site', 'src/app.js', 'script'),
    ),
    "planted_declarations": (
        ('blog', 'posts/models.py', 'Post', 'class', 1, True, False),
        ('blog', 'posts/views.py', '_private', 'def', 8, False, False),
        ('blog', 'posts/views.py', 'archives', 'def', 3, True, False),
        ('mixed', 'app.py', 'search', 'def', 5, True, True),
        ('mixed', 'lib/Models/User.php', 'User', 'class', 3, True, False),
        ('mixed', 'lib/main.dart', 'Main', 'class', 2, True, False),
        ('mixed', 'lib/pages/home.dart', 'Home', 'class', 1, True, False),
        ('mixed', 'main.go', 'main', 'func', 2, False, False),
        ('mixed', 'src/main/java/org/acme/Api.java', 'Api', 'class', 4, True, True),
        ('mixed', 'src/main/java/org/acme/util/Tools.java', 'Tools', 'class', 2, True, False),
        ('mono', 'apps/web/pages/blog/[slug].js', 'Page', 'function', 1, True, False),
        ('mono', 'apps/web/src/main.tsx', 'App', 'const', 5, True, False),
        ('mono', 'apps/web/vendor-x.js', 'x', 'const', 1, True, False),
        ('mono', 'packages/kit/src/button.tsx', 'Button', 'const', 1, True, False),
        ('mono', 'packages/kit/src/button.tsx', 'styles', 'const', 2, False, False),
        ('mono', 'packages/kit/src/colors.ts', 'tone', 'const', 1, True, False),
        ('site', 'api/server.js', 'app', 'const', 2, False, False),
        ('site', 'api/server.js', 'express', 'const', 1, False, False),
        ('site', 'api/server.js', 'key', 'const', 6, False, False),
        ('site', 'src/app.js', 'start', 'function', 3, False, False),
        ('site', 'src/orphan.js', 'alone', 'const', 2, False, False),
        ('site', 'src/orphan.js', 'hidden', 'function', 3, False, False),
        ('site', 'src/query.js', 'find', 'function', 1, True, False),
        ('site', 'src/query.js', 'id', 'const', 2, False, False),
        ('site', 'src/utils.js', 'forgotten', 'function', 2, True, False),
        ('site', 'src/utils.js', 'used', 'function', 1, True, False),
    ),
    "planted_functions": (
        ('Page', 1, 1, 1, 0, 1),
        ('_private', 8, 9, 2, 3, 1),
        ('archives', 3, 6, 4, 1, 2),
        ('find', 1, 5, 5, 2, 1),
        ('forgotten', 2, 2, 1, 1, 1),
        ('hidden', 3, 3, 1, 0, 1),
        ('main', 2, 4, 3, 0, 1),
        ('search', 5, 6, 2, 0, 1),
        ('start', 3, 7, 5, 2, 3),
        ('used', 1, 1, 1, 1, 1),
        ('util', 6, 8, 3, 1, 1),
    ),
    "planted_identifiers": (
        ('site', '$', 1, 1),
        ('site', 'a', 3, 1),
        ('site', 'alone', 1, 1),
        ('site', 'app', 5, 1),
        ('site', 'b', 2, 1),
        ('site', 'console', 1, 1),
        ('site', 'const', 5, 3),
        ('site', 'db', 2, 1),
        ('site', 'debugger', 1, 1),
        ('site', 'default', 1, 1),
        ('site', 'el', 1, 1),
        ('site', 'eval', 1, 1),
        ('site', 'export', 3, 2),
        ('site', 'exports', 2, 2),
        ('site', 'express', 2, 1),
        ('site', 'find', 2, 1),
        ('site', 'forgotten', 1, 1),
        ('site', 'from', 2, 1),
        ('site', 'function', 5, 4),
        ('site', 'get', 2, 1),
        ('site', 'hash', 1, 1),
        ('site', 'hidden', 1, 1),
        ('site', 'id', 3, 1),
        ('site', 'if', 1, 1),
        ('site', 'import', 2, 1),
        ('site', 'innerHTML', 1, 1),
        ('site', 'key', 1, 1),
        ('site', 'list', 1, 1),
        ('site', 'listen', 1, 1),
        ('site', 'location', 1, 1),
        ('site', 'log', 1, 1),
        ('site', 'lost', 1, 1),
        ('site', 'module', 2, 2),
        ('site', 'other', 1, 1),
        ('site', 'post', 1, 1),
        ('site', 'query', 2, 1),
        ('site', 'req', 2, 1),
        ('site', 'require', 1, 1),
        ('site', 'return', 6, 4),
        ('site', 'save', 1, 1),
        ('site', 'start', 2, 1),
        ('site', 'used', 3, 2),
        ('site', 'window', 1, 1),
        ('site', 'x', 4, 1),
    ),
    "planted_elements": (
        ('index.html', 'a', 6, 'out', 'html>body'),
        ('index.html', 'a', 6, 'prices', 'html>body'),
        ('index.html', 'a', 6, 'x', 'html>body'),
        ('index.html', 'body', 3, 'Shop News x prices out', 'html'),
        ('index.html', 'h1', 4, 'Shop', 'html>body'),
        ('index.html', 'h4', 5, 'News', 'html>body'),
        ('index.html', 'head', 2, 'Home', 'html'),
        ('index.html', 'html', 1, 'Home Shop News x prices out', ''),
        ('index.html', 'img', 7, '', 'html>body'),
        ('index.html', 'input', 10, '', 'html>body'),
        ('index.html', 'script', 8, '', 'html>body'),
        ('index.html', 'script', 9, 'var data = {{ rows|safe }};', 'html>body'),
        ('index.html', 'title', 2, 'Home', 'html>head'),
        ('prices.html', 'body', 2, 'Prices Ten & more <each>', 'html'),
        ('prices.html', 'h1', 2, 'Prices', 'html>body'),
        ('prices.html', 'head', 2, 'Home', 'html'),
        ('prices.html', 'html', 2, 'Home Prices Ten & more <each>', ''),
        ('prices.html', 'p', 2, 'Ten & more <each>', 'html>body'),
        ('prices.html', 'title', 2, 'Home', 'html>head'),
    ),
    "planted_style_declarations": (
        ('.a', 1, 'background', '#ffffff'),
        ('.a', 1, 'color', '#999'),
        ('.a', 1, 'font-size', '10px'),
        ('.b', 2, 'color', 'rgb(0, 0, 0)'),
        ('.b', 2, 'z-index', '99999'),
        ('.c', 3, 'margin', '0'),
        ('body', 1, 'margin', '0'),
    ),
    "planted_masks": (
        ('$a = " ";    ',),
        ("a = '    ';           \nb = `  ${f(q)}  `;         r =       ;",),
        ("a { }         c { d: ' ' }",),
        ("move 'x'",),
        ("select ' '     ",),
        ('x =     {call(y)}        ',),
    ),
    "planted_comment_ranges": (
        (12, 22),
        (30, 37),
    ),
    "planted_script_zones": (
        (178, 178, 'module', True),
        (195, 241, '', True),
        (244, 244, '', True),
        (262, 289, '', True),
        (80, 115, 'importmap', False),
    ),
    "planted_matches_in_scripts": (
        (276, '', True),
    ),
    "planted_skipped_lines": (
        ('mono', 'ci.yml', 2),
        ('mono', 'ci.yml', 3),
        ('mono', 'packages/kit/src/button.tsx', 2),
        ('mono', 'packages/kit/src/button.tsx', 3),
        ('mono', 'packages/kit/src/button.tsx', 4),
    ),
    "planted_origins": (
        ('A', 46, 'literal'),
        ('a', 82, 'literal'),
        ('p', 82, 'parameter'),
        ('q', 82, 'external'),
        ('r', 82, 'unknown'),
        ('t', 82, 'unknown'),
        ('x', 46, 'parameter'),
        ('y', 46, 'external'),
        ('zz', 82, 'unknown'),
    ),
    "planted_pattern_rules": (
        ('DEAD-DEBUG-INSTRUCTION-DEBUGGER', 'high', 'site', 'src/app.js', 9, 'firm'),
        ('DJANGO-SECRET-KEY-HARDCODED', 'critical', 'blog', 'main/settings.py', 3, 'firm'),
        ('LARAVEL-GUARDED-EMPTY', 'high', 'mixed', 'lib/Models/User.php', 4, 'firm'),
        ('SEC-DEBUG-ON', 'medium', 'blog', 'main/settings.py', 2, 'tentative'),
        ('SEC-DOCKER-LATEST', 'low', 'site', 'Dockerfile', 1, 'firm'),
        ('SEC-DOCKER-ROOT', 'medium', 'site', 'Dockerfile', 1, 'firm'),
        ('SEC-DONNEES-DANS-SCRIPT', 'high', 'site', 'index.html', 9, 'firm'),
        ('SEC-ENV-COMMITTED', 'critical', 'site', '.env', 1, 'firm'),
        ('SEC-INNERHTML', 'high', 'site', 'src/app.js', 10, 'firm'),
        ('SEC-PATH-TRAVERSAL', 'high', 'mixed', 'app.py', 6, 'firm'),
        ('SEC-SQL-CONCAT', 'critical', 'site', 'src/query.js', 3, 'firm'),
        ('SEC-TEMPLATE-AUTOESCAPE', 'medium', 'site', 'index.html', 9, 'firm'),
    ),
    "planted_secrets": (
        ('SEC-SECRET-AWS-ACCESS-KEY', 'critical', 'api/server.js', 6, "const key = 'AKIA****************';", 'certain'),
        ('SEC-SECRET-GENERIC-SECRET', 'high', '.env', 1, 'API_TOKEN=x9Qm************', 'firm'),
    ),
    "planted_page_rules": (
        ('A11Y-INPUT-NO-LABEL', 'high', 'site', 'index.html', 10),
        ('A11Y-NO-MAIN-LANDMARK', 'medium', 'site', 'index.html', None),
        ('A11Y-NO-MAIN-LANDMARK', 'medium', 'site', 'prices.html', None),
        ('A11Y-NO-SKIP-LINK', 'low', 'site', 'index.html', None),
        ('A11Y-NO-SKIP-LINK', 'low', 'site', 'prices.html', None),
        ('ROUTE-TARGET-BLANK', 'medium', 'site', 'index.html', 6),
        ('SEO-CANONICAL-MISSING', 'medium', 'site', 'index.html', None),
        ('SEO-CANONICAL-MISSING', 'medium', 'site', 'prices.html', None),
        ('SEO-CHARSET-MISSING', 'medium', 'site', 'index.html', None),
        ('SEO-CHARSET-MISSING', 'medium', 'site', 'prices.html', None),
        ('SEO-DESC-MISSING', 'high', 'site', 'index.html', None),
        ('SEO-DESC-MISSING', 'high', 'site', 'prices.html', None),
        ('SEO-FAVICON-MISSING', 'info', 'site', 'index.html', None),
        ('SEO-FAVICON-MISSING', 'info', 'site', 'prices.html', None),
        ('SEO-HEADING-SKIP', 'low', 'site', 'index.html', 5),
        ('SEO-IMG-ALT-MISSING', 'medium', 'site', 'index.html', 7),
        ('SEO-IMG-NO-DIMENSIONS', 'low', 'site', 'index.html', 7),
        ('SEO-IMG-NO-LAZY', 'info', 'site', 'index.html', 7),
        ('SEO-LANG-MISSING', 'high', 'site', 'index.html', None),
        ('SEO-OG-MISSING', 'medium', 'site', 'index.html', None),
        ('SEO-OG-MISSING', 'medium', 'site', 'prices.html', None),
        ('SEO-STRUCTURED-DATA', 'medium', 'site', 'index.html', None),
        ('SEO-STRUCTURED-DATA', 'medium', 'site', 'prices.html', None),
        ('SEO-THIN-CONTENT', 'low', 'site', 'index.html', None),
        ('SEO-THIN-CONTENT', 'low', 'site', 'prices.html', None),
        ('SEO-TITLE-DUPLICATED-PAGES', 'medium', 'site', 'index.html', None),
        ('SEO-TITLE-SHORT', 'medium', 'site', 'index.html', None),
        ('SEO-TITLE-SHORT', 'medium', 'site', 'prices.html', None),
        ('SEO-VIEWPORT-MISSING', 'high', 'site', 'index.html', None),
        ('SEO-VIEWPORT-MISSING', 'high', 'site', 'prices.html', None),
        ('UX-NO-AUTOCOMPLETE', 'low', 'site', 'index.html', 10),
    ),
    "planted_style_rules": (
        ('A11Y-CONTRAST', 'high', 'styles/main.css', 1, 'Contrast 2.85:1, wanted 4.5:1'),
        ('DESIGN-FONT-TOO-SMALL', 'medium', 'styles/main.css', 1, 'Text too small'),
        ('DESIGN-NO-DARK-MODE', 'info', None, None, 'No dark mode'),
    ),
    "planted_quality_rules": (
        ('QUAL-DEEP-NESTING', 'low', 'p', 'src/deep.js', 9),
        ('QUAL-DUPLICATION', 'low', 'p', 'src/one.py', 1),
        ('QUAL-DUPLICATION', 'low', 'p', 'src/one.py', 2),
        ('QUAL-DUPLICATION', 'low', 'p', 'src/one.py', 3),
        ('QUAL-HIGH-COMPLEXITY', 'medium', 'p', 'src/long.py', 1),
        ('QUAL-LONG-FUNCTION', 'low', 'p', 'src/long.py', 1),
        ('QUAL-TOO-MANY-PARAMS', 'low', 'p', 'src/long.py', 1),
        ('QUAL-YAML-ECHAPPEMENT-INVALIDE', 'high', 'p', 'c.yml', 1),
    ),
    "planted_dead_code": (
        ('DEAD-ASSET', 'site', 'styles/main.css', None, None),
        ('DEAD-EXPORT', 'site', 'src/query.js', 1, 'find'),
        ('DEAD-EXPORT', 'site', 'src/utils.js', 2, 'forgotten'),
        ('DEAD-FILE', 'site', 'src/orphan.js', None, None),
        ('DEAD-FILE', 'site', 'src/query.js', None, None),
        ('DEAD-IMPORT', 'blog', 'manage.py', 1, 'os'),
        ('DEAD-IMPORT', 'mixed', 'src/main/java/org/acme/Api.java', 2, 'Tools'),
        ('DEAD-IMPORT', 'mono', 'apps/web/src/main.tsx', 1, 'React'),
        ('DEAD-IMPORT', 'site', 'src/app.js', 2, 'lost'),
        ('DEAD-LOCAL', 'mono', 'packages/kit/src/button.tsx', 2, 'styles'),
        ('DEAD-LOCAL', 'site', 'api/server.js', 6, 'key'),
        ('DEAD-LOCAL', 'site', 'src/orphan.js', 2, 'alone'),
        ('DEAD-LOCAL', 'site', 'src/orphan.js', 3, 'hidden'),
        ('DEAD-UNREACHABLE', 'site', 'src/app.js', 6, "console.log('never');"),
    ),
    "planted_route_rules": (
        ('ROUTE-BROKEN-LINK', 'high', 'site', 'index.html', 6, '/nowhere'),
        ('ROUTE-DUPLICATE', 'medium', 'site', 'api/server.js', 4, 'GET /api/users'),
        ('ROUTE-MISSING-ASSET', 'medium', 'site', 'index.html', 7, '/public/banner.png'),
        ('ROUTE-NO-404', 'medium', 'blog', None, None, None),
        ('ROUTE-NO-404', 'medium', 'mixed', None, None, None),
        ('ROUTE-NO-404', 'medium', 'site', None, None, None),
        ('ROUTE-ORPHAN', 'medium', 'mono', 'apps/web/index.html', 1, '/apps/web'),
    ),
    "planted_project_rules": (
        ('DEP-NO-LOCKFILE', 'medium', 'mono'),
        ('DJANGO-HARDENING-MISSING', 'medium', 'blog'),
        ('QUAL-NO-LINTER', 'low', 'mono'),
        ('QUAL-NO-LINTER', 'low', 'site'),
        ('QUAL-NO-TEST-SCRIPT', 'low', 'mono'),
        ('QUAL-NO-TEST-SCRIPT', 'low', 'site'),
        ('QUAL-THIN-README', 'info', 'site'),
        ('SEC-MISSING-HEADERS', 'medium', 'mixed'),
        ('SEC-MISSING-HEADERS', 'medium', 'site'),
        ('SEO-MANIFEST-MISSING', 'info', 'mono'),
        ('SEO-MANIFEST-MISSING', 'info', 'site'),
        ('SEO-ROBOTS-MISSING', 'medium', 'mono'),
        ('SEO-ROBOTS-MISSING', 'medium', 'site'),
        ('SEO-SITEMAP-MISSING', 'medium', 'mono'),
        ('SEO-SITEMAP-MISSING', 'medium', 'site'),
        ('SEO-SPA-NO-SSR', 'high', 'mono'),
    ),
    "planted_query_loops": (
        ('PERF-NESTED-LOOP-QUERY', 'blog', 'posts/views.py', 5, 'Post.objects.get(pk=post)'),
    ),
    "planted_heavy_assets": (
        ('PERF-HEAVY-ASSET', 'medium', 'd.js'),
        ('PERF-HEAVY-IMAGE', 'high', 'b.png'),
        ('PERF-HEAVY-IMAGE', 'medium', 'a.png'),
        ('PERF-HEAVY-SVG', 'low', 'c.svg'),
    ),
    "planted_frameworks": (
        ('blog', 'django', 'requirements.txt'),
        ('blog', 'python', 'main/settings.py'),
        ('mixed', 'flask', 'app.py'),
        ('mixed', 'flutter', 'pubspec.yaml'),
        ('mixed', 'laravel', 'composer.json'),
        ('mixed', 'rails', 'config/routes.rb'),
        ('mono', 'react', 'apps/web/package.json'),
        ('site', 'express', 'package.json'),
    ),
    "planted_platforms": (
        ('blog', 'web'),
        ('mixed', 'mobile'),
        ('mixed', 'web'),
        ('mono', 'web'),
        ('site', 'api'),
        ('site', 'web'),
    ),
    "planted_project_labels": (
        ('blog', 'Django site'),
        ('mixed', 'Flutter app'),
        ('mono', 'React app'),
        ('site', 'Express service'),
    ),
    "planted_libraries": (
        ('blog', False),
        ('mixed', False),
        ('mono', False),
        ('site', True),
    ),
    "planted_monorepos": (
        ('blog', 0, False),
        ('mixed', 0, False),
        ('mono', 2, True),
        ('site', 0, False),
    ),
    "planted_perimeters": (
        ('blog', '', 9),
        ('mixed', '', 11),
        ('mono', '', 3),
        ('mono', 'apps/web', 7),
        ('mono', 'packages/kit', 4),
        ('site', '', 13),
    ),
    "planted_manifests": (
        ('blog', 'PyPI', 'django', '==4.2.1', 'prod'),
        ('blog', 'PyPI', 'requests', '>=2.0', 'prod'),
        ('mixed', 'Packagist', 'laravel/framework', '^10.0', 'prod'),
        ('mono', 'npm', '@acme/kit', '1.0.0', 'prod'),
        ('mono', 'npm', 'react', '^18.2.0', 'prod'),
        ('site', 'npm', 'express', '^4.18.0', 'prod'),
        ('site', 'npm', 'lodash', '^4.17.11', 'prod'),
        ('site', 'npm', 'never-imported', '*', 'prod'),
        ('site', 'npm', 'request', '2.88.0', 'prod'),
    ),
    "planted_locks": (
        ('@s/d', '4.0.0', 'npm', True),
        ('a', '1.1.2', 'npm', True),
        ('b', '2.0.0', 'npm', True),
        ('c', '3.1.0', 'npm', True),
        ('g', '7.0.0', 'Pub', True),
        ('h', '8.0.0', 'PyPI', False),
        ('k', '1.2', 'PyPI', False),
        ('l', '1.0.0', 'npm', True),
        ('m', '2.0.0', 'npm', True),
        ('n', '3.0.0', 'crates.io', True),
        ('v/e', '5.0.1', 'Packagist', True),
        ('v/f', '6.0.0', 'Packagist', True),
    ),
    "planted_vulnerable": (
        ('Flask', '2.0.0', 'A-3', 'medium', None),
        ('left', '1.5.0-rc.1', 'A-4', 'low', None),
        ('lodash', '4.17.11', 'A-1', 'critical', '4.17.12'),
        ('lodash', '4.17.11', 'A-2', 'medium', '4.17.21'),
    ),
    "planted_vulnerable_packages": (
        ('Flask', 'medium', 1, None),
        ('left', 'low', 1, None),
        ('lodash', 'critical', 2, '4.17.21'),
    ),
    "planted_dependency_rules": (
        ('DEP-CACHE-STALE', 'medium', None, 'Advisories are 100 days old'),
        ('DEP-DEPRECATED', 'medium', 'site', 'request is given up'),
        ('DEP-UNPINNED', 'medium', 'site', 'never-imported'),
        ('DEP-UNUSED', 'low', 'site', 'lodash is not imported'),
        ('DEP-UNUSED', 'low', 'site', 'never-imported is not imported'),
        ('DEP-UNUSED', 'low', 'site', 'request is not imported'),
        ('DEP-VULNERABLE', 'critical', 'p', 'lodash 4.17.11 fixed in 4.17.21'),
        ('DEP-VULNERABLE', 'low', 'p', 'left 1.5.0-rc.1 fixed in no version'),
        ('DEP-VULNERABLE', 'medium', 'p', 'Flask 2.0.0 fixed in no version'),
        ('PERF-HEAVY-DEPENDENCY', 'info', 'site', 'lodash is heavy'),
    ),
    "planted_dependency_rules_offline": (
        ('DEP-NO-OSV-SYNC', 'medium', 'p', 'No advisories at hand'),
        ('DEP-VULNERABLE', 'high', 'p', 'Flask below 2.2.5'),
        ('DEP-VULNERABLE', 'high', 'p', 'lodash below 4.17.21'),
    ),
    "planted_audit_reports": (
        ('DEP-AUDIT', 'critical', 'audit.json', 'Reported: b'),
        ('DEP-AUDIT', 'medium', 'audit.json', 'Reported: a'),
    ),
    "planted_robots": (
        ('allow', '/private/open'),
        ('disallow', '/private'),
    ),
    "planted_crawl_rules": (
        ('CRAWL-BROKEN-PAGE', 'high', 'https://a.example/gone', 'Status 404'),
        ('CRAWL-CANONICAL-MISMATCH', 'medium', 'https://a.example/b', 'Canonical address is another page'),
        ('CRAWL-DUPLICATE-TITLE', 'medium', 'https://a.example/', '2 pages'),
        ('CRAWL-EMPTY-HTML', 'high', 'https://a.example/private/x', 'Page without content before scripts run'),
        ('CRAWL-HEADER-CONTENT-SECURITY-POLICY', 'high', 'https://a.example/', 'Header content-security-policy missing'),
        ('CRAWL-HEADER-REFERRER-POLICY', 'low', 'https://a.example/', 'Header referrer-policy missing'),
        ('CRAWL-HEADER-STRICT-TRANSPORT-SECURITY', 'medium', 'https://a.example/', 'Header strict-transport-security missing'),
        ('CRAWL-HEADER-X-CONTENT-TYPE-OPTIONS', 'low', 'https://a.example/', 'Header x-content-type-options missing'),
        ('CRAWL-HEADER-X-FRAME-OPTIONS', 'medium', 'https://a.example/', 'Header x-frame-options missing'),
        ('CRAWL-MIXED-CONTENT', 'high', 'https://a.example/', '1 insecure resources'),
        ('CRAWL-NO-COMPRESSION', 'medium', 'https://a.example/fail', '1 pages'),
        ('CRAWL-NOINDEX-LIVE', 'critical', 'https://a.example/private/x', 'Live page kept out of search'),
        ('CRAWL-REDIRECT-CHAIN', 'medium', 'https://a.example/moved', '2 redirects'),
        ('CRAWL-ROBOTS-BLOCKED', 'medium', 'https://a.example/private/x', 'Linked page kept from crawlers'),
        ('CRAWL-ROBOTS-NO-SITEMAP', 'low', None, 'robots.txt without a sitemap'),
        ('CRAWL-SERVER-ERROR', 'critical', 'https://a.example/fail', 'Status 500'),
        ('CRAWL-SLOW-RESPONSE', 'high', 'https://a.example/fail', '2 slow pages'),
        ('CRAWL-TEMPORARY-REDIRECT', 'low', 'https://a.example/moved', 'Temporary redirect'),
        ('CRAWL-UNREACHABLE', 'high', 'https://a.example/dead', 'timeout'),
        ('CRAWL-VERSION-DISCLOSURE', 'low', 'https://a.example/', 'nginx/1.2'),
    ),
    "planted_crawl_summary": (
        ('p', 8, 3, 1, 100.0, 1),
    ),
    "planted_outbound": (
        ('b.example', 1, 1),
    ),
    "planted_frontier": (
        ('https://a', 0),
        ('https://a/x', 1),
        ('https://a/y', 2),
    ),
    "planted_load_rules": (
        ('PERF-CLS-INSTABLE', 'high', '0.30'),
        ('PERF-LCP-LENT', 'high', '5000 ms'),
        ('PERF-POIDS-TOTAL', 'medium', 'script:900000 style:250000'),
        ('PERF-REQUETES-NOMBREUSES', 'low', '90 requests'),
        ('PERF-RESSOURCE-LOURDE', 'low', 's.css: 244 KiB'),
        ('PERF-RESSOURCE-LOURDE', 'medium', 'app.js: 878 KiB'),
        ('PERF-TTFB-LENT', 'low', '900 ms'),
    ),
    "planted_external": (
        ('CRAWL-EXTERNAL-DEAD', 'https://a/', 'No answer: https://x'),
    ),
    "planted_leaked_lines": (
        ('aaaaaaa1', '2024-01-01', 'src/a.js', 'aws-access-key', 'AKIA****************'),
        ('bbbbbbb2', '2024-02-01', 'tests/b.js', 'aws-access-key', 'AKIA****************'),
    ),
    "planted_leaks": (
        ('aws-access-key', 'aaaaaaa1', 'bbbbbbb2', 2, 2, 0, False, 'AWS console, IAM, security credentials'),
    ),
    "planted_fixes": (
        ('mono', 'apps/web/index.html', 'charset', 1),
        ('mono', 'apps/web/index.html', 'viewport', 1),
        ('mono', 'apps/web/src/main.tsx', 'unused-imports', 1),
        ('site', 'index.html', 'autocomplete', 1),
        ('site', 'index.html', 'charset', 1),
        ('site', 'index.html', 'noopener', 1),
        ('site', 'index.html', 'viewport', 1),
        ('site', 'prices.html', 'charset', 1),
        ('site', 'prices.html', 'viewport', 1),
        ('site', 'src/app.js', 'debugger', 1),
        ('site', 'src/app.js', 'unused-imports', 1),
    ),
    "planted_fixed_files": (
        ('index.html', 4, '<html>\n<head>\n  <meta charset="utf-8">\n  <meta name="viewport" content="width=device-width, initial-scale=1"><title>Home</title></head>\n<body>\n<h1>Shop</h1>\n<h4>News</h4>\n<a href="/nowhere">x</a> <a href="/prices">prices</a> <a href="https://other.example/a" target="_blank" rel="noopener">out</a>\n<img src="/public/banner.png">\n<script src="/src/app.js"></script>\n<script>var data = {{ rows|safe }};</script>\n<input type="email" autocomplete="email">\n</body>\n</html>\n'),
        ('prices.html', 2, '<!doctype html>\n<html lang="en"><head>\n  <meta charset="utf-8">\n  <meta name="viewport" content="width=device-width, initial-scale=1"><title>Home</title></head><body><h1>Prices</h1><p>Ten &amp; more &lt;each&gt;</p></body></html>\n'),
        ('src/app.js', 2, "import { used } from './utils.js';\nfunction start(a, b) {\n  if (a && b) { return used(a); }\n  return 1;\n  console.log('never');\n}\nexport default start;\nel.innerHTML = window.location.hash;\n"),
    ),
    "planted_directives": (
        (1, ''),
        (4, 'SEC-X'),
        (5, 'QUAL'),
        (7, 'QUAL'),
    ),
    "planted_ignored": (
        ('a.css', True),
        ('a.min.js', True),
        ('a1.txt', True),
        ('ab.txt', False),
        ('public/a', True),
        ('public/js/a', False),
        ('src/a.js', False),
        ('src/public/a', False),
        ('x/node_modules/a.js', True),
        ('x/tests/a/b', True),
    ),
    "planted_settings": (
        ('json', '', '{"a": "//b",  "d": [1]} '),
        ('toml', 'a.b.y', '2'),
        ('toml', 'x', '1'),
        ('yaml', 'a.b', '1'),
        ('yaml', 'a.d', 'e'),
    ),
    "planted_compact_report": (
        ('-:0: [info] QUAL-C Title C',),
        ('a.js:3: [critical] SEC-A Title A',),
        ('b.html:0: [medium] SEO-B Title B',),
    ),
    "planted_annotations": (
        ('::error file=a.js,line=3,title=SEC-A::Message, A',),
        ('::warning file=b.html,line=1,title=SEO-B::50%25 more%0Alines',),
    ),
    "planted_sarif_results": (
        ('{"ruleId":"QUAL-C","level":"note","message":{"text":"C"}}',),
        ('{"ruleId":"SEC-A","level":"error","message":{"text":"Message, A"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"a.js"},"region":{"startLine":3}}}]}',),
        ('{"ruleId":"SEO-B","level":"warning","message":{"text":"50% more\\nlines"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"b.html"}}}]}',),
    ),
    "planted_json_report": (
        ('{"rule_id":"QUAL-C","category":"quality","severity":"info","title":"Title C","message":"C","project":"p"}',),
        ('{"rule_id":"SEC-A","category":"security","severity":"critical","title":"Title A","message":"Message, A","project":"p","file":"a.js","line":3}',),
        ('{"rule_id":"SEO-B","category":"seo","severity":"medium","title":"Title B","message":"50% more\\nlines","project":"p","file":"b.html"}',),
    ),
    "planted_scores": (
        ('deadcode', 100, 'A+', 0, 0, 0, 0),
        ('dependencies', 100, 'A+', 0, 0, 0, 0),
        ('design', 100, 'A+', 0, 0, 0, 0),
        ('performance', 100, 'A+', 0, 0, 0, 0),
        ('quality', 100, 'A+', 1, 0, 0, 1),
        ('routes', 100, 'A+', 0, 0, 0, 0),
        ('security', 65, 'D', 1, 1, 0, 0),
        ('seo', 94, 'A', 1, 0, 1, 0),
    ),
    "planted_summary": (
        ('deadcode       100 A+ 0 findings',),
        ('dependencies   100 A+ 0 findings',),
        ('design         100 A+ 0 findings',),
        ('performance    100 A+ 0 findings',),
        ('quality        100 A+ 1 findings',),
        ('routes         100 A+ 0 findings',),
        ('security        65 D  1 findings',),
        ('seo             94 A  1 findings',),
    ),
    "planted_review": (
        ('## Findings in this change\n\n\n### a.js\n- critical: Title A (line 3, SEC-A)\n\n### b.html\n- medium: Title B (line 0, SEO-B)\n',),
    ),
    "planted_sarif_lines": (
        (0, '{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "auditlake", "rules": ['),
        (1, ',{"id":"QUAL-C","shortDescription":{"text":"Title C"},"properties":{"security-severity":"1.0"}}'),
        (1, ',{"id":"SEO-B","shortDescription":{"text":"Title B"},"properties":{"security-severity":"5.5"}}'),
        (1, '{"id":"SEC-A","shortDescription":{"text":"Title A"},"properties":{"security-severity":"9.5"}}'),
        (2, ']}}, "results": ['),
        (3, ',{"ruleId":"QUAL-C","level":"note","message":{"text":"C"}}'),
        (3, ',{"ruleId":"SEO-B","level":"warning","message":{"text":"50% more\\nlines"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"b.html"}}}]}'),
        (3, '{"ruleId":"SEC-A","level":"error","message":{"text":"Message, A"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"a.js"},"region":{"startLine":3}}}]}'),
        (4, ']}]}'),
    ),
    "planted_terminal": (
        (0, 'critical C                                b.js:0  X'),
        (0, 'critical C                                b.js:1  X'),
        (0, 'critical C                                b.js:2  X'),
        (0, 'critical C                                b.js:3  X'),
        (3, 'low      R                                a.js:0  T0'),
        (3, 'low      R                                a.js:1  T1'),
        (3, 'low      R                                a.js:2  T2'),
        (9, '2 more'),
    ),
    "planted_job_log": (
        ('quality: 1 findings, 0 severe',),
        ('security: 1 findings, 1 severe',),
        ('seo: 1 findings, 0 severe',),
    ),
    "planted_review_texts": (
        ('findings', '## Findings in this change\n'),
        ('nothing', None),
        ('resolved', 'All findings of this change are resolved.\n'),
    ),
    "planted_comment_runs": (
        ('p', 'a.js', 2, 5),
    ),
    "planted_unreachable": (
        ('a.js', 4, 'g();'),
    ),
    "planted_windows": (
        ('2024-01-01', 'A', 2),
        ('2024-01-02', 'B', 1),
    ),
    "planted_durations": (
        (3000000, '1 month'),
        (5, 'now'),
        (60, '1 minute'),
        (700000, '1 week'),
        (70000000, '2 years'),
        (7300, '2 hours'),
        (90000, '1 day'),
    ),
    "planted_languages_asked": (
        (None, 'en_GB.UTF-8', 'en'),
        ('', 'FR', 'fr'),
        ('en', 'fr_FR.UTF-8', 'en'),
        ('xx', None, 'fr'),
    ),
    "planted_translation_coverage": (
        ('en', 1, 3, 0.3333),
        ('fr', 2, 3, 0.6667),
    ),
    "planted_audit": (
        ('DEAD-ASSET', 1),
        ('DEAD-DEBUG-INSTRUCTION-DEBUGGER', 1),
        ('DEAD-EXPORT', 2),
        ('DEAD-FILE', 2),
        ('DEAD-IMPORT', 1),
        ('DEAD-LOCAL', 3),
        ('DEAD-UNREACHABLE', 1),
        ('SEC-DOCKER-LATEST', 1),
        ('SEC-DOCKER-ROOT', 1),
        ('SEC-DONNEES-DANS-SCRIPT', 1),
        ('SEC-ENV-COMMITTED', 1),
        ('SEC-INNERHTML', 1),
        ('SEC-MISSING-HEADERS', 1),
        ('SEC-SECRET-AWS-ACCESS-KEY', 1),
        ('SEC-SECRET-GENERIC-SECRET', 1),
        ('SEC-SQL-CONCAT', 1),
        ('SEC-TEMPLATE-AUTOESCAPE', 1),
    ),
    "planted_text_functions": (
        ('', 0, '', '****', 0.0, 1, False),
        ('<p>Ten <b>big</b> words a</p><script>x</script>', 3, 'Ten big words a', '<p>T****************', 4.0323, 1, False),
        ('a: "b\\d"', 2, 'a: "b\\d"', 'a:****', 2.75, 1, True),
        ('if (a && b) { for (;;) {} } else if (c) { }', 10, 'if (a && b) { for (;;) {} } else if (c) { }', 'if (****************', 3.5686, 5, False),
        ('sk_live_abcdefgh1234', 1, 'sk_live_abcdefgh1234', 'sk_l****************', 4.1219, 1, False),
    ),
    "planted_places": (
        (0, 1, 1),
        (1, 1, 2),
        (3, 2, 1),
        (5, 2, 3),
        (7, 3, 1),
        (8, 4, 1),
    ),
    "planted_sizes": (
        (0, '0 B'),
        (1024, '1.0 KiB'),
        (1536, '1.5 KiB'),
        (3000000000, '2861.0 MiB'),
        (5000000, '4.8 MiB'),
        (512, '512 B'),
    ),
    "planted_path_functions": (
        ('.env.local', '', '.env.local', '.local', 'dotenv', 'dotenv', False, False, False, False),
        ('App.vue', '', 'App.vue', '.vue', 'vue', 'js', False, False, False, False),
        ('Dockerfile', '', 'Dockerfile', '', 'docker', 'docker', False, False, False, False),
        ('a/b/c.unknown', 'a/b', 'c.unknown', '.unknown', 'unknown', 'unknown', False, False, False, False),
        ('img/a.PNG', 'img', 'a.PNG', '.png', 'unknown', 'unknown', False, False, True, True),
        ('node_modules/x/y.js', 'node_modules/x', 'y.js', '.js', 'javascript', 'js', False, True, False, False),
        ('src/a.test.ts', 'src', 'a.test.ts', '.ts', 'typescript', 'js', True, False, False, False),
        ('tests/a.py', 'tests', 'a.py', '.py', 'python', 'python', True, False, False, False),
        ('views/a.blade.php', 'views', 'a.blade.php', '.php', 'blade', 'php', False, False, False, False),
        ('x/font.woff2', 'x', 'font.woff2', '.woff2', 'unknown', 'unknown', False, False, False, True),
    ),
    "planted_route_patterns": (
        ('/', '/', '^//?$', False),
        ('/a/{b}/c?d=1', '/a/{b}/c', '^/a/[^/]+/c/?$', False),
        ('/files/*', '/files/*', '^/files/.*/?$', False),
        ('/plain', '/plain', '^/plain/?$', False),
        ('/x/<int:y>', '/x/<int:y>', '^/x/[^/]+/?$', False),
        ('users//:id/', '/users/:id', '^/users/[^/]+/?$', True),
    ),
    "planted_file_routes": (
        ('(group)/about/page.tsx', '/about'),
        ('a/index.vue', '/a'),
        ('blog/[slug].js', '/blog/:slug'),
        ('docs/[...all].tsx', '/docs/*'),
        ('index.html', '/'),
        ('users/[[id]].ts', '/users/:id'),
    ),
    "planted_urls": (
        ('//cdn.example/a/b.js', '//cdn.example/a/b.js', '//cdn.example/a/b.js', '/a/b.js', 'b.js'),
        ('/rel/p.css?v=1', '/rel/p.css?v=1', '/rel/p.css', '/rel/p.css?v=1', 'p.css'),
        ('https://A.example/X/', 'https://A.example/X', 'https://a.example/x', '/X/', 'X'),
        ('https://a.example/x/?utm_source=b&c=1#d', 'https://a.example/x/?c=1', 'https://a.example/x', '/x/?utm_source=b&c=1', 'x'),
    ),
    "planted_colors": (
        ('#12345678', '#8f9faf', 0.3373, 2.71, 'fail', None),
        ('#999', '#999999', 0.3185, 2.85, 'fail', None),
        ('1.5rem', None, None, None, None, 24.0),
        ('hsl(120, 100%, 25%)', '#008000', 0.1544, 5.14, 'AA', None),
        ('none', None, None, None, None, None),
        ('rgb(0, 128, 255)', '#0080ff', 0.2266, 3.8, 'AA large', None),
        ('rgba(0,0,0,0.5)', '#808080', 0.2159, 3.95, 'AA large', None),
        ('white', '#ffffff', 1.0, 1.0, 'fail', None),
    ),
    "planted_suggested_colors": (
        ('#000000', '#000000', True),
        ('#999999', '#757575', True),
        ('#ff8888', '#c34c4c', True),
    ),
    "planted_versions": (
        ('*', None, None, 'info'),
        ('1.5.0-rc.1', '1.5.0-rc.1', -1, 'low'),
        ('2.10.0', '2.10.0', 1, 'medium'),
        ('>=2.0 <3', '2.0.0', -1, 'medium'),
        ('^1.2.3', '1.2.3', -1, 'critical'),
        ('v3.1.4', '3.1.4', 1, 'info'),
        ('~4.0', '4.0.0', 1, 'high'),
    ),
    "planted_interpolation": (
        ('none', 'none'),
        ('{n} of {m}', '3 of 4'),
        ('{other} {n}', '{other} 3'),
    ),
}
