from flask import Flask, jsonify, request

app = Flask(__name__)


@app.route('/api/accounts', methods=['POST'])
def list_accounts():
    return jsonify({"accountId": 1, "ownerEmail": "x@y.z", "nickname": "n"})


@app.route('/api/accounts/<int:account_id>')
def get_account(account_id):
    return jsonify({
        "balance": 10,
        "KEY_CONST": 1,
        "meta": {"openedAt": "2024"},
    })


@app.route('/api/signup')
def signup():
    body = request.json
    login = body.get('loginName')
    secret = request.json['passphrase']
    return {"created": True, "__private": 1}


def not_a_route():
    return {"hiddenKey": 1}


@app.route('/api/search')
def search():
    term = request.args.get('term')
    tag = request.form.get('tag')
    return {"results": []}
