"""The pattern catalog: what an endpoint looks like in each language and framework.

Fixed values: the patterns decide what is found. A row: framework, kind, method group, route group,
label and pattern; groups and labels may be missing. Patterns match across lines and without regard to case.
"""

# Fixed values, by language in alphabetical order and in the order in which they are tried.
CATALOG: dict[str, list[tuple[str, str, int | None, int | None, str | None, str]]] = {
    "crystal": [
        ('Kemal', 'ENDPOINT', 1, 2, None, r"""\b(get|post|put|patch|delete)\s+["\']([^"\']+)["\'].*\bdo\b"""),
        ('Kemal', 'ENTRY', None, None, 'Kemal.run', r'Kemal\.run'),
        ('Lucky', 'ENDPOINT', 1, 2, None, r"""\b(get|post|put|patch|delete)\s+["\']([^"\']+)["\']"""),
        ('Lucky', 'ENDPOINT', None, 1, 'resources', r'resources\s+:(\w+),\s+\w+'),
        ('Amber', 'CONFIG', None, 1, 'routes', r'routes\s+:\w+,\s+(\w+Router)'),
        ('Amber', 'ENTRY', None, None, 'Amber::Server', r'Amber::Server\.start'),
        ('Grip', 'ENDPOINT', 1, 2, None, r"""def\s+(get|post|put|delete|patch)\s+["\']([^"\']+)["\']"""),
        ('Marten', 'ENDPOINT', None, 1, None, r"""path\s+["\']([^"\']+)["\'],\s+\w+"""),
        ('Marten', 'ENTRY', None, None, 'Marten.setup', r'Marten\.setup'),
    ],
    "dotnet": [
        ('MinimalAPI', 'ENDPOINT', 1, 2, None, r"""app\.Map(Get|Post|Put|Delete|Patch)\s*\(\s*["\']([^"\']+)["\']"""),
        ('MinimalAPI', 'ENDPOINT', 1, 2, None, r"""endpoints\.Map(Get|Post|Put|Delete|Patch)\s*\(\s*["\']([^"\']+)["\']"""),
        ('ASP.NET', 'ENDPOINT', None, 1, None, r"""\.MapHealthChecks\s*\(\s*["\']([^"\']+)["\']"""),
        ('SignalR', 'ENDPOINT', None, 1, None, r"""\.MapHub<\w+>\s*\(\s*["\']([^"\']+)["\']"""),
        ('gRPC', 'ENDPOINT', None, 1, None, r'\.MapGrpcService<(\w+)>'),
    ],
    "elixir": [
        ('Phoenix', 'ENDPOINT', 1, 2, None, r"""\b(get|post|put|patch|delete)\s+["\']([^"\']+)["\'],\s+\w+Controller"""),
        ('Phoenix', 'ENDPOINT', None, 1, 'resources', r"""resources\s+["\']([^"\']+)["\'],\s+\w+Controller"""),
        ('Phoenix', 'CONFIG', None, 1, 'scope', r"""scope\s+["\']([^"\']+)["\']"""),
        ('Phoenix', 'CONFIG', None, 1, 'pipe_through', r'pipe_through\s+:(\w+)'),
        ('Phoenix', 'ENDPOINT', None, 1, 'LiveView', r"""live\s+["\']([^"\']+)["\'],\s+\w+Live"""),
        ('Plug', 'ENDPOINT', 1, 2, None, r"""\b(get|post|put|patch|delete)\s+["\']([^"\']+)["\']"""),
        ('Plug', 'ENDPOINT', None, 1, None, r"""match\s+["\']([^"\']+)["\']"""),
        ('Plug', 'CONFIG', None, 1, 'forward', r"""forward\s+["\']([^"\']+)["\']"""),
    ],
    "go": [
        ('net/http', 'ENDPOINT', None, 1, None, r"""http\.HandleFunc\s*\(\s*["`]([^"`]+)["`]"""),
        ('net/http', 'ENDPOINT', None, 1, None, r"""http\.Handle\s*\(\s*["`]([^"`]+)["`]"""),
        ('Gin', 'ENDPOINT', 1, 2, None, r"""(?:router|r|g|engine)\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s*\(\s*["`]([^"`]+)["`]"""),
        ('Echo', 'ENDPOINT', 1, 2, None, r"""(?:e|echo)\.(GET|POST|PUT|DELETE|PATCH)\s*\(\s*["`]([^"`]+)["`]"""),
        ('Fiber', 'ENDPOINT', 1, 2, None, r"""(?:app|fiber)\.(Get|Post|Put|Delete|Patch)\s*\(\s*["`]([^"`]+)["`]"""),
        ('Beego', 'ENDPOINT', None, 1, None, r"""beego\.Router\s*\(\s*["`]([^"`]+)["`]"""),
        ('Beego', 'ENDPOINT', 1, 2, None, r"""(?:beego|ns)\.(Get|Post|Put|Delete|Patch|Head|Options)\s*\(\s*["`]([^"`]+)["`]"""),
        ('Beego', 'ENDPOINT', None, 1, None, r"""web\.Router\s*\(\s*["`]([^"`]+)["`]"""),
        ('Chi', 'ENDPOINT', 1, 2, None, r"""(?:r|router|mux)\.(Get|Post|Put|Delete|Patch|Head|Options|Connect|Trace)\s*\(\s*["`]([^"`]+)["`]"""),
        ('Chi', 'CONFIG', None, None, 'chi.NewRouter', r'chi\.NewRouter\s*\('),
        ('Chi', 'CONFIG', None, 1, 'Route group', r"""(?:r|router)\.Route\s*\(\s*["`]([^"`]+)["`]"""),
        ('Gorilla Mux', 'CONFIG', None, None, 'mux.NewRouter', r'mux\.NewRouter\s*\('),
        ('Gorilla Mux', 'ENDPOINT', None, 1, None, r"""\.HandleFunc\s*\(\s*["`]([^"`]+)["`]"""),
        ('Gorilla Mux', 'ENDPOINT', 2, 1, None, r"""\.Path\s*\(\s*["`]([^"`]+)["`]\s*\)\.Methods\s*\(\s*["`](GET|POST|PUT|DELETE|PATCH)["`]"""),
        ('Gorilla Mux', 'CONFIG', None, 1, 'PathPrefix', r"""\.PathPrefix\s*\(\s*["`]([^"`]+)["`]"""),
        ('fasthttp', 'ENTRY', None, None, 'fasthttp Server', r'fasthttp\.ListenAndServe\s*\('),
        ('fasthttp', 'ENDPOINT', 1, 2, None, r"""(?:router|r)\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s*\(\s*["`]([^"`]+)["`]"""),
        ('fasthttp', 'CONFIG', None, None, 'fasthttp method', r'fasthttp\.MethodGet|fasthttp\.MethodPost'),
        ('go-zero', 'ENDPOINT', None, 1, None, r'@handler\s+(\w+)'),
        ('go-zero', 'ENDPOINT', 1, 2, None, r'(get|post|put|delete|patch)\s+(/[/\w:.-]*)'),
        ('go-zero', 'CONFIG', None, None, '@server', r'@server\s*\('),
    ],
    "java": [
        ('Spring', 'CONFIG', None, None, '@RestController', r'@RestController'),
        ('Spring', 'ENDPOINT', None, 1, None, r"""@RequestMapping\s*\(\s*(?:value\s*=\s*)?["\']([^"\']+)["\']"""),
        ('Spring', 'ENDPOINT', None, 1, 'GET', r"""@GetMapping\s*(?:\(\s*(?:value\s*=\s*)?["\']([^"\']*)["\'])?"""),
        ('Spring', 'ENDPOINT', None, 1, 'POST', r"""@PostMapping\s*(?:\(\s*(?:value\s*=\s*)?["\']([^"\']*)["\'])?"""),
        ('Spring', 'ENDPOINT', None, 1, 'PUT', r"""@PutMapping\s*(?:\(\s*(?:value\s*=\s*)?["\']([^"\']*)["\'])?"""),
        ('Spring', 'ENDPOINT', None, 1, 'DELETE', r"""@DeleteMapping\s*(?:\(\s*(?:value\s*=\s*)?["\']([^"\']*)["\'])?"""),
        ('Spring', 'ENDPOINT', None, 1, 'PATCH', r"""@PatchMapping\s*(?:\(\s*(?:value\s*=\s*)?["\']([^"\']*)["\'])?"""),
        ('Vert.x', 'ENDPOINT', 1, 2, None, r"""router\.(get|post|put|delete|patch|head|options)\s*\(\s*["\']([^"\']+)["\']"""),
        ('Vert.x', 'ENDPOINT', None, 1, None, r"""router\.route\s*\(\s*["\']([^"\']+)["\']"""),
        ('Vert.x', 'ENDPOINT', 1, None, None, r'\.method\s*\(\s*HttpMethod\.(GET|POST|PUT|DELETE|PATCH)\s*\)'),
        ('Armeria', 'ENDPOINT', 1, 2, None, r"""@(Get|Post|Put|Delete|Patch)\s*\(\s*["\']([^"\']+)["\']"""),
        ('Armeria', 'ENDPOINT', None, 1, None, r"""\.service\s*\(\s*["\']([^"\']+)["\']"""),
        ('Armeria', 'CONFIG', None, None, 'Armeria Server', r'Server\.builder\s*\('),
        ('JSP/Servlet', 'ENDPOINT', None, 1, None, r'<url-pattern>\s*([^<]+)\s*</url-pattern>'),
        ('JSP/Servlet', 'ENDPOINT', None, 1, None, r"""@WebServlet\s*\(\s*["\']([^"\']+)["\']"""),
        ('Play Framework', 'ENDPOINT', 1, 2, None, r'^(GET|POST|PUT|DELETE|PATCH)\s+(/[^\s]+)'),
        ('JAX-RS', 'ENDPOINT', None, 1, None, r"""@Path\s*\(\s*["\']([^"\']+)["\']"""),
        ('JAX-RS', 'ENDPOINT', 1, None, None, r'@(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b(?!\s*\()'),
    ],
    "javascript": [
        ('Express', 'ENDPOINT', 1, 2, None, r"""(?:app|router)\.(get|post|put|delete|patch|all)\s*\(\s*["\'\`]([^"\'\`]+)["\'\`]"""),
        ('NestJS', 'ENDPOINT', 1, 2, None, r"""@(Get|Post|Put|Delete|Patch)\s*\(\s*["\'\`]?([^"\'\`\)]*)["\'\`]?\s*\)"""),
        ('NestJS', 'CONFIG', None, 1, 'Controller', r"""@Controller\s*\(\s*["\'\`]([^"\'\`]+)["\'\`]\s*\)"""),
        ('Fastify', 'ENDPOINT', 1, 2, None, r"""(?:fastify|app|server)\.(get|post|put|delete|patch|head|options)\s*\(\s*["\'\`]([^"\'\`]+)["\'\`]"""),
        ('Fastify', 'CONFIG', None, 1, 'prefix', r"""fastify\.register\s*\([^,]+,\s*\{\s*prefix:\s*["\'\`]([^"\'\`]+)["\'\`]"""),
        ('Fastify', 'ENDPOINT', 1, 2, None, r"""\.route\s*\(\s*\{\s*method:\s*["\'\`](GET|POST|PUT|DELETE|PATCH)["\'\`]\s*,\s*url:\s*["\'\`]([^"\'\`]+)["\'\`]"""),
        ('Koa', 'ENDPOINT', 1, 2, None, r"""router\.(get|post|put|delete|patch|all)\s*\(\s*["\'\`]([^"\'\`]+)["\'\`]"""),
        ('Koa', 'CONFIG', None, 1, 'Router prefix', r"""new Router\s*\(\s*\{\s*prefix:\s*["\'\`]([^"\'\`]+)["\'\`]"""),
        ('Koa', 'CONFIG', None, None, 'KoaRouter', r'new KoaRouter\s*\('),
        ('NuxtJS', 'ENDPOINT', None, None, 'defineEventHandler', r'export\s+default\s+defineEventHandler'),
        ('NuxtJS', 'ENDPOINT', None, None, 'Event Handler', r'defineEventHandler\s*\('),
        ('NuxtJS', 'ENDPOINT', None, None, 'eventHandler', r'eventHandler\s*\('),
        ('Restify', 'ENDPOINT', 1, 2, None, r"""(?:server|app)\.(get|post|put|patch|del|head|opts)\s*\(\s*["\'\`]([^"\'\`]+)["\'\`]"""),
        ('Restify', 'CONFIG', None, None, 'Restify Server', r'restify\.createServer\s*\('),
        ('TanStack Router', 'ENDPOINT', None, 1, None, r"""createRoute\s*\(\s*\{[^}]*path:\s*["\'\`]([^"\'\`]+)["\'\`]"""),
        ('TanStack Router', 'ENDPOINT', None, 1, None, r"""new Route\s*\(\s*\{[^}]*path:\s*["\'\`]([^"\'\`]+)["\'\`]"""),
        ('TanStack Router', 'CONFIG', None, None, 'Root Route', r'createRootRoute\s*\('),
        ('Hapi', 'ENDPOINT', None, 1, None, r"""server\.route\s*\(\s*\{[^}]*path:\s*["\'\`]([^"\'\`]+)["\'\`]"""),
        ('Hapi', 'ENDPOINT', 1, None, None, r"""server\.route\s*\(\s*\{[^}]*method:\s*["\'\`](GET|POST|PUT|DELETE|PATCH)["\'\`]"""),
        ('Hono', 'ENDPOINT', 1, 2, None, r"""(?:app|hono)\.(get|post|put|delete|patch|all)\s*\(\s*["\'\`]([^"\'\`]+)["\'\`]"""),
    ],
    "kotlin": [
        ('Ktor', 'ENDPOINT', 1, 2, None, r"""\b(get|post|put|delete|patch|head|options)\s*\(\s*["\']([^"\']+)["\']"""),
        ('Ktor', 'CONFIG', None, 1, 'route group', r"""route\s*\(\s*["\']([^"\']+)["\']"""),
        ('Ktor', 'CONFIG', None, None, 'routing {}', r'routing\s*\{'),
        ('Ktor', 'ENTRY', None, None, 'embeddedServer', r'embeddedServer\s*\('),
        ('Spring', 'ENDPOINT', None, 1, 'GET', r"""@GetMapping\s*(?:\(\s*(?:value\s*=\s*)?["\']([^"\']*)["\'])?"""),
        ('Spring', 'ENDPOINT', None, 1, 'POST', r"""@PostMapping\s*(?:\(\s*(?:value\s*=\s*)?["\']([^"\']*)["\'])?"""),
        ('Spring', 'ENDPOINT', None, 1, 'PUT', r"""@PutMapping\s*(?:\(\s*(?:value\s*=\s*)?["\']([^"\']*)["\'])?"""),
        ('Spring', 'ENDPOINT', None, 1, 'DELETE', r"""@DeleteMapping\s*(?:\(\s*(?:value\s*=\s*)?["\']([^"\']*)["\'])?"""),
        ('Spring', 'ENDPOINT', None, 1, None, r"""@RequestMapping\s*\(\s*(?:value\s*=\s*)?["\']([^"\']+)["\']"""),
        ('Spring', 'CONFIG', None, None, '@RestController', r'@RestController'),
    ],
    "php": [
        ('Laravel', 'ENDPOINT', 1, 2, None, r"""Route::(get|post|put|patch|delete|any)\s*\(\s*["\']([^"\']+)["\']"""),
        ('Laravel', 'ENDPOINT', None, 1, 'resource', r"""Route::resource\s*\(\s*["\']([^"\']+)["\']"""),
        ('Laravel', 'ENDPOINT', None, 1, 'apiResource', r"""Route::apiResource\s*\(\s*["\']([^"\']+)["\']"""),
        ('Laravel', 'CONFIG', None, None, 'Route::group', r'Route::group\s*\(\s*\['),
        ('Laravel', 'CONFIG', None, 1, 'prefix', r"""->prefix\s*\(\s*["\']([^"\']+)["\']"""),
        ('Laravel', 'CONFIG', None, None, 'Route::controller', r'Route::controller\s*\(\s*\w+::class\s*\)->group'),
        ('Symfony', 'ENDPOINT', 2, 1, None, r"""#\[Route\s*\(\s*["\']([^"\']+)["\'](?:[^)]*methods:\s*\[([^\]]+)\])?"""),
        ('Symfony', 'ENDPOINT', 2, 1, None, r"""@Route\s*\(\s*["\']([^"\']+)["\'](?:[^)]*methods\s*=\s*\{([^}]+)\})?"""),
        ('Symfony', 'ENDPOINT', None, 1, 'GET', r"""#\[Get\s*\(\s*["\']([^"\']+)["\']"""),
        ('Symfony', 'ENDPOINT', None, 1, 'POST', r"""#\[Post\s*\(\s*["\']([^"\']+)["\']"""),
    ],
    "python": [
        ('Flask', 'ENDPOINT', 2, 1, None, r"""@(?:app|blueprint|bp)\.route\s*\(\s*["\']([^"\']+)["\'](?:.*?methods\s*=\s*\[([^\]]+)\])?"""),
        ('Flask', 'ENDPOINT', 1, 2, None, r"""@(?:app|blueprint|bp)\.(get|post|put|delete|patch)\s*\(\s*["\']([^"\']+)["\']"""),
        ('FastAPI', 'ENDPOINT', 1, 2, None, r"""@(?:app|router)\.(get|post|put|delete|patch|options|head)\s*\(\s*["\']([^"\']+)["\']"""),
        ('FastAPI', 'ENDPOINT', None, 1, 'APIRouter', r"""APIRouter\s*\(\s*(?:prefix\s*=\s*)?["\']([^"\']+)["\']"""),
        ('Django', 'ENDPOINT', None, 1, None, r"""path\s*\(\s*["\']([^"\']+)["\']"""),
        ('Django', 'ENDPOINT', None, 1, None, r"""url\s*\(\s*r?["\']([^"\']+)["\']"""),
        ('Gevent-WSGI', 'ENTRY', None, None, 'WSGI Server Entry', r'gevent\.pywsgi\.WSGIServer|from\s+gevent\.pywsgi\s+import\s+WSGIServer'),
        ('Gevent-WSGI', 'ENTRY', None, 1, 'WSGI Server', r"""WSGIServer\s*\(\s*\(?["\']?([^"\')\s,]*)["\']?,?\s*(\d+)?\)?"""),
        ('OpenAPI-Custom', 'ENDPOINT', None, None, 'OpenAPIRouter', r'OpenAPIRouter\s*\('),
        ('OpenAPI-Custom', 'ENDPOINT', None, 1, None, r"""\.add_api_route\s*\(\s*["\']([^"\']+)["\']"""),
        ('Custom-Router', 'ENDPOINT', 1, 2, None, r"""\.add_route\s*\(\s*["\'](\w+)["\'],\s*["\']([^"\']+)["\']"""),
        ('Flask-Manual', 'ENDPOINT', None, 1, None, r"""\.add_url_rule\s*\(\s*["\']([^"\']+)["\']"""),
        ('Worker-CLI', 'WORKER', None, None, 'Worker --kind', r"""add_argument\s*\(\s*["\']--kind["\']"""),
        ('Worker-CLI', 'WORKER', None, None, 'Worker --conf', r"""add_argument\s*\(\s*["\']--conf["\']"""),
        ('Worker-CLI', 'WORKER', None, None, 'Worker --worker', r"""add_argument\s*\(\s*["\']--worker["\']"""),
        ('Celery', 'WORKER', None, 1, 'Celery Task', r"""@(?:app|celery)\.task(?:\s*\(\s*(?:name\s*=\s*)?["\']([^"\']+)["\'])?"""),
        ('Waitress', 'ENTRY', None, None, 'Waitress Server', r'waitress\.serve\s*\('),
        ('Uvicorn', 'ENTRY', None, None, 'Uvicorn ASGI', r'uvicorn\.run\s*\('),
        ('Gunicorn', 'ENTRY', None, None, 'Gunicorn', r'gunicorn'),
        ('MCP', 'TOOL', None, 1, None, r'@(?:server|mcp)\.tool\s*\(\s*\)\s*(?:async\s+)?def\s+(\w+)'),
        ('MCP', 'TOOL', None, 1, None, r"""@(?:server|mcp)\.tool\s*\(\s*(?:name\s*=\s*)?["\']([^"\']+)["\']"""),
        ('MCP', 'TOOL', None, None, 'list_tools', r'@(?:server|mcp)\.list_tools\s*\(\s*\)'),
        ('MCP', 'TOOL', None, None, 'call_tool', r'@(?:server|mcp)\.call_tool\s*\(\s*\)'),
        ('MCP', 'TOOL', None, 1, None, r"""Tool\s*\(\s*name\s*=\s*["\']([^"\']+)["\']"""),
        ('MCP', 'RESOURCE', None, 1, None, r"""@(?:server|mcp)\.resource\s*\(\s*["\']([^"\']+)["\']"""),
        ('MCP', 'RESOURCE', None, None, 'list_resources', r'@(?:server|mcp)\.list_resources\s*\(\s*\)'),
        ('MCP', 'RESOURCE', None, 1, None, r"""Resource\s*\(\s*uri\s*=\s*["\']([^"\']+)["\']"""),
        ('Sanic', 'ENDPOINT', 1, 2, None, r"""@(?:app|bp|blueprint)\.(get|post|put|delete|patch)\s*\(\s*["\']([^"\']+)["\']"""),
        ('Sanic', 'ENDPOINT', 2, 1, None, r"""@(?:app|bp|blueprint)\.route\s*\(\s*["\']([^"\']+)["\'](?:.*?methods\s*=\s*\[([^\]]+)\])?"""),
        ('Sanic', 'CONFIG', None, 1, 'Blueprint', r"""Blueprint\s*\(\s*["\']([^"\']+)["\']"""),
        ('Tornado', 'ENTRY', None, None, 'Tornado App', r'tornado\.web\.Application\s*\(\s*\['),
        ('Tornado', 'ENDPOINT', None, 1, None, r"""\(\s*r?["\']([^"\']+)["\'],\s*\w+Handler\s*\)"""),
        ('Tornado', 'HANDLER', None, 1, None, r'class\s+(\w*Handler)\s*\(\s*tornado\.web\.RequestHandler\s*\)'),
        ('Starlette', 'ENDPOINT', None, 1, None, r"""Route\s*\(\s*["\']([^"\']+)["\']"""),
        ('Starlette', 'CONFIG', None, 1, 'Mount', r"""Mount\s*\(\s*["\']([^"\']+)["\']"""),
        ('Bottle', 'ENDPOINT', 1, 2, None, r"""@(?:app|bottle)\.(get|post|put|delete|patch)\s*\(\s*["\']([^"\']+)["\']"""),
        ('Bottle', 'ENDPOINT', None, 1, None, r"""@(?:app|bottle)\.route\s*\(\s*["\']([^"\']+)["\']"""),
        ('Quart', 'CONFIG', None, None, 'Quart app', r'from\s+quart\s+import'),
        ('Health', 'ENDPOINT', None, None, '/health', r"""["\']/?health(?:z|check)?["\']"""),
        ('Prometheus', 'ENDPOINT', None, None, '/metrics', r"""["\']/?metrics["\']"""),
    ],
    "ruby": [
        ('Rails', 'ENDPOINT', 1, 2, None, r"""\b(get|post|put|patch|delete)\s+["\']([^"\']+)["\']"""),
        ('Rails', 'ENDPOINT', None, 1, 'resources', r'resources\s+:(\w+)'),
        ('Rails', 'ENDPOINT', None, 1, 'resource', r'resource\s+:(\w+)'),
        ('Rails', 'CONFIG', None, 1, 'namespace', r'namespace\s+:(\w+)'),
        ('Rails', 'CONFIG', None, 1, 'scope', r"""scope\s+["\']([^"\']+)["\']"""),
        ('Rails', 'ENDPOINT', None, 1, 'root', r"""root\s+["\']([^"\']+)["\']"""),
        ('Rails', 'ENDPOINT', 2, 1, None, r"""match\s+["\']([^"\']+)["\'](?:.*?via:\s*:(\w+))?"""),
        ('Sinatra', 'ENDPOINT', 1, 2, None, r"""\b(get|post|put|patch|delete)\s+["\']([^"\']+)["\'].*\bdo\b"""),
        ('Hanami', 'ENDPOINT', 1, 2, None, r"""\b(get|post|put|patch|delete)\s+["\']([^"\']+)["\'],\s*to:"""),
        ('Hanami', 'CONFIG', None, 1, 'slice', r'slice\s*\(\s*:(\w+)'),
    ],
    "rust": [
        ('Actix Web', 'ENDPOINT', 1, 2, None, r"""#\[(get|post|put|delete|patch|head|options)\s*\(\s*["\']([^"\']+)["\']"""),
        ('Actix Web', 'ENDPOINT', 1, None, 'web method', r'web::(get|post|put|delete|patch)\s*\('),
        ('Actix Web', 'ENDPOINT', 2, 1, None, r"""\.route\s*\(\s*["\']([^"\']+)["\'],\s*web::(get|post|put|delete|patch)"""),
        ('Actix Web', 'CONFIG', None, 1, 'scope', r"""web::scope\s*\(\s*["\']([^"\']+)["\']"""),
        ('Axum', 'ENDPOINT', None, 1, None, r"""\.route\s*\(\s*["\']([^"\']+)["\']"""),
        ('Axum', 'CONFIG', None, None, 'Router::new', r'Router::new\s*\('),
        ('Axum', 'ENDPOINT', 1, None, None, r'routing::(get|post|put|delete|patch)\s*\('),
        ('Rocket', 'ENDPOINT', 1, 2, None, r"""#\[route\s*\(\s*(GET|POST|PUT|DELETE|PATCH)\s*,\s*path\s*=\s*["\']([^"\']+)["\']"""),
        ('Rocket', 'ENDPOINT', 1, 2, None, r"""#\[(get|post|put|delete|patch)\s*\(\s*["\']([^"\']+)["\']"""),
        ('Rocket', 'CONFIG', None, None, 'rocket::build', r'rocket::build\s*\('),
        ('Tide', 'ENDPOINT', None, 1, None, r"""app\.at\s*\(\s*["\']([^"\']+)["\']"""),
        ('Tide', 'CONFIG', None, None, 'tide::new', r'tide::new\s*\('),
        ('Warp', 'ENDPOINT', None, 1, None, r'warp::path\s*!\s*\(([^)]+)\)'),
        ('Warp', 'ENDPOINT', None, 1, None, r"""warp::path\s*\(\s*["\']([^"\']+)["\']"""),
        ('Warp', 'ENDPOINT', 1, None, None, r'warp::(get|post|put|delete|patch)\s*\('),
        ('Gotham', 'ENDPOINT', None, 1, None, r'route\.request\s*\(\s*vec!\s*\[([^\]]+)\]'),
        ('Gotham', 'CONFIG', None, None, 'build_simple_router', r'build_simple_router\s*\('),
        ('Loco', 'ENDPOINT', None, 1, None, r"""router\.add\s*\(\s*["\']([^"\']+)["\']"""),
        ('Loco', 'CONFIG', None, None, '#[controller]', r'#\[controller\]'),
    ],
    "scala": [
        ('Play Framework', 'ENDPOINT', 1, 2, None, r'^(GET|POST|PUT|DELETE|PATCH)\s+(/[^\s]+)'),
        ('Akka HTTP', 'ENDPOINT', None, 1, None, r"""\bpath\s*\(\s*["\']([^"\']+)["\']"""),
        ('Akka HTTP', 'CONFIG', None, 1, 'pathPrefix', r"""pathPrefix\s*\(\s*["\']([^"\']+)["\']"""),
        ('Akka HTTP', 'ENDPOINT', 1, None, None, r'\b(get|post|put|delete|patch|head|options)\s*\{'),
        ('Akka HTTP', 'ENDPOINT', None, 1, None, r"""path\s*!\s*["\']([^"\']+)["\']"""),
        ('Akka HTTP', 'ENTRY', None, None, 'Http().bindAndHandle', r'Http\s*\(\s*\)\s*\.bindAndHandle'),
        ('Scalatra', 'ENDPOINT', 1, 2, None, r"""\b(get|post|put|patch|delete)\s*\(\s*["\']([^"\']+)["\']"""),
        ('Scalatra', 'CONFIG', None, None, 'ScalatraServlet', r'extends\s+ScalatraServlet'),
    ],
    "swift": [
        ('Vapor', 'ENDPOINT', 1, 2, None, r"""app\.(get|post|put|patch|delete)\s*\(\s*["\']([^"\']+)["\']"""),
        ('Vapor', 'ENDPOINT', 1, 2, None, r"""routes\.(get|post|put|patch|delete)\s*\(\s*["\']([^"\']+)["\']"""),
        ('Vapor', 'CONFIG', None, 1, 'grouped', r"""app\.grouped\s*\(\s*["\']([^"\']+)["\']"""),
        ('Vapor', 'ENDPOINT', 1, None, None, r'app\.on\s*\(\s*\.(get|post|put|patch|delete)'),
        ('Hummingbird', 'ENDPOINT', 1, 2, None, r"""router\.(get|post|put|patch|delete)\s*\(\s*["\']([^"\']+)["\']"""),
        ('Hummingbird', 'ENDPOINT', 2, 1, None, r"""router\.add\s*\(\s*["\']([^"\']+)["\'],\s*method:\s*\.(get|post|put|patch|delete)"""),
        ('Hummingbird', 'ENTRY', None, None, 'HBApplication', r'HBApplication\s*\('),
        ('Kitura', 'ENDPOINT', 1, 2, None, r"""router\.(get|post|put|patch|delete)\s*\(\s*["\']([^"\']+)["\']"""),
        ('Kitura', 'ENTRY', None, None, 'Kitura.addHTTPServer', r'Kitura\.addHTTPServer\s*\('),
        ('Kitura', 'ENDPOINT', None, 1, 'ANY', r"""router\.all\s*\(\s*["\']([^"\']+)["\']"""),
    ],
}

#: Lines that begin so, after blanks, are comments: matches that begin there don't count.
COMMENTS: dict[str, tuple[str, ...]] = {
    "crystal": ("#",), "elixir": ("#",), "python": ("#",), "ruby": ("#",), "go": ("//",), "rust": ("//",), "dotnet": ("//", "*"), "java": ("//", "*"),
    "javascript": ("//", "*"), "kotlin": ("//", "*"), "scala": ("//", "*"), "swift": ("//", "*"), "php": ("//", "#", "*"),
}

#: Which scanner reads a file.
EXTENSIONS: dict[str, str] = {
    ".py": "python", ".cs": "dotnet", ".go": "go", ".java": "java", ".js": "javascript", ".ts": "javascript", ".jsx": "javascript", ".tsx": "javascript", ".mjs": "javascript",
    ".rb": "ruby", ".rs": "rust", ".php": "php", ".kt": "kotlin", ".kts": "kotlin", ".cr": "crystal", ".ex": "elixir", ".exs": "elixir", ".scala": "scala", ".swift": "swift",
    ".json": "spec", ".yaml": "spec", ".yml": "spec", ".graphql": "spec", ".gql": "spec",
}

#: Folders that aren't scanned.
IGNORED_DIRS: list[str] = (
    ".git .svn .hg .bzr node_modules bower_components jspm_packages __pycache__ .pytest_cache .mypy_cache .tox .nox venv .venv env .env virtualenv .virtualenv "
    "site-packages .eggs dist build egg-info bin obj .vs packages TestResults artifacts target .gradle .idea .settings vendor .next .nuxt coverage .cache .parcel-cache "
    ".vscode .DS_Store docs doc _site test tests spec specs __tests__ fixtures mocks stubs mock stub e2e integration unit __mocks__ testdata test_data"
).split()
