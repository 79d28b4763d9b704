"""Frameworks and entities told from the text of a symbol, by ordered rules as one expression each.

Bodies (sym_id, path, name, type, body) are taken as delivered; null bodies give no label. A symbol delivered
twice counts once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: label, pattern of the name (after ! one that it must not have) or None, then lists of texts: one of each list must stand in the body; the first rule that fits decides ----
_RN = ["View", "Text", "TouchableOpacity", "FlatList", "ScrollView", "SafeAreaView", "StatusBar", "Alert", "Modal"]
_HOOKS = ["useState", "useEffect", "useContext", "useReducer", "useMemo"]
FUNCTION_RULES = [
    ("react-native-hook", None, ["useNavigation", "useRoute", "useAnimatedStyle", "useSharedValue"]),
    ("react-native-util", None, ["StyleSheet.create", "Dimensions.get", "PixelRatio"]),
    ("react-native-component", "^[A-Z]", [x for c in _RN for x in ("<" + c, c + ">")]),
    ("expo", None, ["expo-", "usePermissions", "useCameraPermissions", "useAssets", "Notifications.schedule"]),
    ("expo-router", None, ["expo-router", "useLocalSearchParams", "useGlobalSearchParams"]),
    ("react-component", "^[A-Z]", _HOOKS),
    ("react-hook", None, _HOOKS),
    ("nextjs-app-router", "^(?:generateMetadata|generateStaticParams)$"),
    ("nextjs-server-action", None, ["'use server'", '"use server"']),
    ("nextjs-client", None, ["'use client'", '"use client"']),
    ("nextjs-ssg", "getServerSideProps|getStaticProps|getStaticPaths"),
    ("nextjs-page", None, ["getServerSideProps", "getStaticProps"]),
    ("nestjs-controller", None, ["@Get(", "@Post(", "@Put(", "@Delete(", "@Patch("]),
    ("nestjs-service", None, ["@Injectable"]),
    ("nestjs-controller", None, ["@Controller"]),
    ("nestjs-guard", None, ["@Guard", "CanActivate"]),
    ("nestjs-pipe", None, ["@Pipe", "PipeTransform"]),
    ("fastapi-endpoint", None, ["@app.get(", "@app.post(", "@router.get(", "@router.post("]),
    ("express-route", None, ["app.get(", "app.post(", "router.get(", "router.post("]),
    ("express-middleware", "!router", ["app.use("]),
    ("fastapi-dependency", None, ["Depends("], ["def "]),
    ("django-view", None, ["request.method", "HttpResponse", "JsonResponse"]),
    ("django-rest", None, ["@api_view", "APIView"]),
    ("flask-route", None, ["@app.route(", "@blueprint.route("]),
    ("remix-loader", "^(?:loader|action)$", ["json(", "redirect("]),
]
JSX_RULES = [
    ("react-component", "^[A-Z]", ["return", "=>"], ["<"]),
]
CLASS_RULES = [
    ("angular-component", None, ["@Component"]),
    ("angular-service", None, ["@Injectable"]),
    ("angular-module", None, ["@NgModule"]),
    ("angular-directive", None, ["@Directive"]),
    ("angular-pipe", None, ["@Pipe"], ["PipeTransform"]),
    ("react-native-component", None, ["extends Component", "extends PureComponent"], ["View", "Text", "TouchableOpacity", "FlatList", "StyleSheet"]),
    ("react-class-component", None, ["extends Component", "extends PureComponent"]),
    ("nestjs-controller", None, ["@Controller"]),
    ("nestjs-module", None, ["@Module"], ["imports:"]),
    ("spring-boot", None, ["@RestController"]),
]
JAVA_RULES = [
    ("android-activity", None, ["extends AppCompatActivity", "extends Activity", "extends FragmentActivity"]),
    ("android-fragment", None, ["extends Fragment", "extends DialogFragment"]),
    ("android-viewmodel", None, ["extends ViewModel", "extends AndroidViewModel"]),
    ("android-service", None, ["extends Service", "extends IntentService"]),
    ("android-receiver", None, ["extends BroadcastReceiver"]),
    ("android-provider", None, ["extends ContentProvider"]),
    ("android-adapter", None, ["extends RecyclerView.Adapter", "extends ArrayAdapter"]),
    ("android-room", None, ["@Entity"], ["@ColumnInfo"]),
    ("android-room", None, ["@Dao"], ["@Query", "@Insert"]),
    ("android-room-db", None, ["@Database"], ["RoomDatabase"]),
    ("android-hilt", None, ["@HiltAndroidApp", "@AndroidEntryPoint"]),
    ("spring-entity", None, ["@Entity", "@Table"]),
    ("spring-repository", None, ["@Repository"]),
    ("spring-service", None, ["@Service"]),
    ("spring-controller", None, ["@Controller", "@RestController"]),
    ("spring-component", None, ["@Component"]),
    ("spring-config", None, ["@Configuration"]),
]
CSHARP_RULES = [
    ("aspnet-controller", None, ["[ApiController]", "ControllerBase"]),
    ("aspnet-webapi", None, ["[Route(", "[HttpGet]", "[HttpPost]"]),
    ("wcf-service", None, ["[DataContract]", "[DataMember]"]),
    ("ef-entity", None, ["DbContext", "DbSet<"]),
]
KOTLIN_RULES = [
    ("compose-ui", None, ["@Composable"]),
    ("compose-preview", None, ["@Preview"]),
    ("android-activity", None, [": AppCompatActivity()", ": Activity()", ": ComponentActivity()"]),
    ("android-fragment", None, [": Fragment()", ": DialogFragment()"]),
    ("android-viewmodel", None, [": ViewModel()", ": AndroidViewModel("]),
    ("android-service", None, [": Service()", ": IntentService("]),
    ("android-receiver", None, [": BroadcastReceiver()"]),
    ("android-provider", None, [": ContentProvider()"]),
    ("ktor-route", None, ["routing {"]),
    ("ktor-route", None, ["get("], ["call.respond"]),
    ("android-room", None, ["@Entity", "@Dao"]),
    ("android-room-db", None, ["@Database"]),
    ("android-hilt", None, ["@HiltViewModel", "@HiltAndroidApp"]),
    ("android-di", None, ["@Inject", "@Module"]),
]
SWIFT_RULES = [
    ("swiftui-view", None, [": View"], ["var body:"]),
    ("swiftui-view", None, ["@ObservedObject", "@StateObject", "@EnvironmentObject"]),
    ("swiftui-observable", None, ["ObservableObject"]),
    ("swiftui-state", None, ["@State ", "@Binding "]),
    ("swiftui-app", "App", ["@main"]),
    ("uikit-viewcontroller", None, [": UIViewController"]),
    ("uikit-tableview", None, [": UITableViewDelegate", ": UITableViewDataSource"]),
    ("uikit-collectionview", None, [": UICollectionViewDelegate"]),
    ("uikit-view", None, [": UIView"]),
    ("combine", None, ["AnyPublisher", "@Published", "sink("]),
    ("coredata-entity", None, [": NSManagedObject", "@NSManaged"]),
    ("coredata", None, ["NSPersistentContainer"]),
    ("vapor-route", None, ["req.content", "app.get(", "app.post("]),
]
DART_RULES = [
    ("flutter-widget", None, ["extends StatelessWidget"]),
    ("flutter-stateful", None, ["extends StatefulWidget"]),
    ("flutter-state", None, ["extends State<"]),
    ("flutter-build", None, ["Widget build("]),
    ("flutter-provider", None, ["extends ChangeNotifier"]),
    ("flutter-getx", None, ["extends GetxController", "extends GetxService"]),
    ("flutter-bloc", None, ["extends Bloc<", "extends Cubit<"]),
    ("dart-equatable", None, ["extends Equatable"]),
    ("flutter-firebase", None, ["FirebaseAuth", "FirebaseFirestore", "FirebaseMessaging"]),
    ("dart-http", None, ["Dio()", "http.get", "http.post"]),
    ("flutter-riverpod", None, ["extends StateNotifier", "extends AsyncNotifier"]),
    ("flutter-riverpod", None, ["extends ConsumerWidget", "extends ConsumerStatefulWidget"]),
]
#: Which rules hold where: endings of the path, types of the symbol (None: any).
RULES = [
    (r"\.(?:js|jsx|ts|tsx|py)$", ["class"], CLASS_RULES),
    (r"\.(?:js|jsx|ts|tsx)$", ["function", "method"], FUNCTION_RULES + JSX_RULES),
    (r"\.py$", ["function", "method"], FUNCTION_RULES),
    (r"\.java$", None, JAVA_RULES),
    (r"\.cs$", None, CSHARP_RULES),
    (r"\.kts?$", None, KOTLIN_RULES),
    (r"\.swift$", None, SWIFT_RULES),
    (r"\.dart$", None, DART_RULES),
]
# ---- fixed values: kinds of entity classes (label, endings of paths, pattern of the body, pattern of the name), in order; any other class is unknown ----
_JS, _PY, _JAVA = r"\.(?:js|jsx|ts|tsx)$", r"\.py$", r"\.java$"
ENTITY_RULES = [
    ("typeorm", _JS, "@Entity", None),
    ("sequelize", _JS, "(?i)sequelize", None),
    ("sequelize", _JS, None, "Model"),
    ("prisma", _JS, "(?i)prisma|@Model", None),
    ("sqlmodel", _PY, "SQLModel|\\bBase\\b", None),
    ("sqlalchemy", _PY, "Flask|SQLAlchemy", None),
    ("django", _PY, "Django|models\\.Model", None),
    ("pydantic", _PY, "[Pp]ydantic|BaseModel", None),
    ("jpa", _JAVA, "@Entity|@Table", None),
]


def _plain(texts: list[str]) -> str:
    """A pattern that finds any of the texts, for Java and for RE2."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t) for t in texts)


def body_patterns(rule: tuple) -> list[str]:
    return [_plain(group) for group in rule[2:]]


def framework_of(path: Column, name: Column, kind: Column, body: Column) -> Column:
    """The framework label of a symbol, or null."""
    out = F.when(body.isNull(), F.lit(None).cast("string"))
    low = F.lower(path)
    for ext, kinds, rules in RULES:
        here = low.rlike(ext) if kinds is None else low.rlike(ext) & kind.isin(kinds)
        label = F.when(F.lit(False), F.lit(None).cast("string"))
        for rule in rules:
            test = F.lit(True) if rule[1] is None else ~name.rlike(rule[1][1:]) if rule[1].startswith("!") else name.rlike(rule[1])
            for pattern in body_patterns(rule):
                test = test & body.rlike(pattern)
            label = label.when(test, rule[0])
        out = out.when(here, label)
    return out


def detected_frameworks(bodies: DataFrame) -> DataFrame:
    """sym_id, framework of the symbols that a rule fits."""
    some = _plain(sorted({t for _, _, rules in RULES for r in rules for t in (r[2] if len(r) > 2 else []) if t not in ("return", "=>")}))
    names = "|".join(f"(?:{r[1]})" for _, _, rules in RULES for r in rules if len(r) == 2)
    # one test before the rules; the last rule of functions needs a capital and a tag
    likely = bodies.where(F.col("body").rlike(some) | F.col("name").rlike(names) | (F.col("name").rlike("^[A-Z]") & F.col("body").contains("<")))
    return likely.select("sym_id", framework_of(F.col("path"), F.col("name"), F.col("type"), F.col("body")).alias("framework")).where("framework is not null").distinct()


def entities(bodies: DataFrame) -> DataFrame:
    """Classes as stored records: sym_id, repo_id, path, name, kind (``unknown`` without a sign of a library), fields (names joined by a blank).

    Fields are the names that the class body itself (indented once) assigns or declares with a type.
    """
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, ext, text, named in ENTITY_RULES:
        test = F.lower("path").rlike(ext)
        test = test & F.col("body").rlike(text) if text else test & F.col("name").rlike(named)
        kind = kind.when(test, label)
    field = F.lit(r"(?m)^(?: {2,4}|\t)(?:(?:public|private|protected|readonly|static|final)\s+)*(\w+)\s*(?::[^=\n(]+)?(?:=\s*[^=\s>]|[;!?]?\s*:\s*\w)")
    fields = F.array_join(F.array_distinct(F.regexp_extract_all("body", field, F.lit(1))), " ")
    rows = bodies.where("type = 'class' and body <> ''").where(F.lower("path").rlike(r"\.(?:js|jsx|ts|tsx|py|java)$"))
    return rows.select("sym_id", "repo_id", "path", "name", F.coalesce(kind, F.lit("unknown")).alias("kind"), fields.alias("fields")).distinct()
